"""License scans by ordered signature rules, in built-in SQL functions only.

Texts are lower-cased (A-Z) and read as words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``.  One
pattern gates a text: without a word of the license vocabulary nothing more runs.  A gated
text is written as words joined by single spaces; then each rule first looks for its
literal keyword and only the few that have it run their regular expression.  A rule's
matches become intervals; an interval that lies in one of a rule of equal or higher
priority is suppressed, so a bare name inside a notice, or a tag inside an address, does
not count again.

Rules are hand-written: sentences of license texts and of the notices that these ask for
(SENTENCES), and for each license (FAMILIES) its names, short names, identifiers and
addresses, of falling priority: address, sentence, notice ("licensed under the ..."),
versioned identifier, bare name.  Members of an SPDX expression of any length are read one
by one and never suppressed.

Null and empty texts have no words, labels or places and score 0; repeated rows give
repeated rows; long texts are scanned whole; other columns are ignored.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


# License families.  label | keyword of names | names | short names, which count
# only in notices | SPDX words | address (all in words joined by single spaces; - for none;
# keyword: text that every name match holds)
FAMILIES = """
mit | mit | (?:the )?mit (?:x11 )?licen[cs]e|mit licensed|expat licen[cs]e mit | mit | mit | opensource org licenses? mit
mit-0 | no attribution | mit no attribution(?: licen[cs]e)? | - | mit 0 | opensource org licenses? mit 0
apache-1.1 | apache | apache (?:software )?licen[cs]e (?:version |v ?)?1 1 | - | apache 1 1 | apache org licenses license 1 1
apache-2.0 | apache | apache (?:software )?licen[cs]e(?: version| v)? 2(?: 0)?|apache 2 0 licen[cs]e|asl 2 0 apache | asl 2 0|apache 2(?: 0)? | apache 2 0 | apache org licenses license 2 0
gpl-1.0 | general public licen | gnu general public licen[cs]e (?:version |v ?)1(?: 0)? | - | gpl 1 0(?: only| or later)? | gnu org licenses old licenses gpl 1 0
gpl-2.0 | general public licen | gnu general public licen[cs]e(?: as published by the free software foundation either)? (?:version |v ?)2(?: 0)? | gpl ?v?2(?: 0)? | gpl 2 0(?: only| or later)? | gnu org licenses old licenses gpl 2 0
gpl-3.0 | general public licen | gnu general public licen[cs]e(?: as published by the free software foundation either)? (?:version |v ?)3(?: 0)? | gpl ?v?3(?: 0)? | gpl 3 0(?: only| or later)? | gnu org licenses gpl 3 0
gpl | general public licen | (?:the )?gnu general public licen[cs]e | gnu gpl|gpl | gpl | gnu org (?:licenses|copyleft) gpl
lgpl-2.0 | general public licen | gnu library general public licen[cs]e(?: (?:version |v ?)2(?: 0)?)? | - | lgpl 2 0(?: only| or later)? | gnu org licenses old licenses lgpl 2 0
lgpl-2.1 | lesser general public licen | gnu lesser general public licen[cs]e (?:version |v ?)2 1 | lgpl ?v?2 1 | lgpl 2 1(?: only| or later)? | gnu org licenses old licenses lgpl 2 1
lgpl-3.0 | lesser general public licen | gnu lesser general public licen[cs]e (?:version |v ?)3(?: 0)? | lgpl ?v?3(?: 0)? | lgpl 3 0(?: only| or later)? | gnu org licenses lgpl 3 0
lgpl | lesser general public licen | (?:the )?gnu lesser general public licen[cs]e | gnu lgpl|lgpl | lgpl | gnu org copyleft lesser
agpl-1.0 | affero general public licen | affero general public licen[cs]e (?:version |v ?)?1(?: 0)? | - | agpl 1 0(?: only| or later)? | affero org oagpl
agpl-3.0 | affero general public licen | (?:the )?gnu affero general public licen[cs]e(?: (?:version |v ?)?3(?: 0)?)? | gnu agpl|agpl(?: ?v?3(?: 0)?)? | agpl 3 0(?: only| or later)? | gnu org licenses agpl(?: 3 0)?
gfdl | free documentation licen | (?:the )?gnu free documentation licen[cs]e(?: (?:version |v ?)?1 [123])? | gnu fdl|gfdl | gfdl 1 [123](?: only| or later)? | gnu org (?:licenses|copyleft) fdl
bsd-2-clause | bsd | (?:simplified|freebsd|2 clause|two clause) bsd licen[cs]e|bsd (?:2|two) clause(?: licen[cs]e)? | - | bsd 2 clause | opensource org licenses? bsd 2 clause
bsd-3-clause | bsd | (?:new|modified|revised|3 clause|three clause) bsd licen[cs]e|bsd (?:3|three) clause(?: licen[cs]e)? | - | bsd 3 clause | opensource org licenses? bsd 3 clause
bsd-4-clause | bsd | (?:original|old|4 clause|four clause) bsd licen[cs]e|bsd (?:4|four) clause(?: licen[cs]e)? | - | bsd 4 clause | -
0bsd | bsd | (?:zero clause|0 clause|free public) bsd licen[cs]e|bsd zero clause(?: licen[cs]e)? | - | 0bsd | opensource org licenses? 0bsd
bsd | bsd | (?:the )?bsd (?:style )?licen[cs]e | bsd | bsd | opensource org licenses? bsd license
isc | isc licen | (?:the )?isc licen[cs]e | isc | isc | opensource org licenses? isc
mpl-1.1 | mozilla public licen | mozilla public licen[cs]e (?:version |v ?)?1 [01] | mpl 1 1 | mpl 1 [01] | mozilla org mpl 1 [01]
mpl-2.0 | mozilla public licen | (?:the )?mozilla public licen[cs]e(?: (?:version |v ?)?2(?: 0)?)? | mpl(?: ?v?2(?: 0)?)? | mpl 2 0 | mozilla org mpl 2 0
epl-1.0 | eclipse public licen | eclipse public licen[cs]e (?:version |v ?)?1(?: 0)? | epl ?v?1(?: 0)? | epl 1 0 | eclipse org legal epl v10
epl-2.0 | eclipse public licen | (?:the )?eclipse public licen[cs]e(?: (?:version |v ?)?2(?: 0)?)? | epl(?: ?v?2(?: 0)?)? | epl 2 0 | eclipse org legal epl (?:2 0|v20)
eupl | european union public licen | (?:the )?european union public licen[cs]e(?: (?:version |v ?)?1 [012])? | eupl | eupl 1 [012] | joinup ec europa eu (?:[a-z0-9]+ ){0,8}eupl
cddl | distribution licen | common development and distribution licen[cs]e(?: (?:version |v ?)?1 [01])? | cddl | cddl 1 [01] | opensource org licenses? cddl1?
cpl-1.0 | common public licen | common public licen[cs]e(?: (?:version |v ?)?1 0)? | - | cpl 1 0 | opensource org licenses? cpl1 0
artistic-1.0 | artistic licen | artistic licen[cs]e (?:version |v ?)?1(?: 0)? | - | artistic 1 0 | opensource org licenses? artistic license 1 0
artistic-2.0 | artistic licen | (?:the )?artistic licen[cs]e(?: (?:version |v ?)?2(?: 0)?)? | - | artistic 2 0 | opensource org licenses? artistic license 2 0
zlib | zlib | (?:the )?zlib(?: libpng)? licen[cs]e | zlib | zlib | opensource org licenses? zlib
libpng | libpng licen | (?:the )?libpng licen[cs]e(?: (?:version |v ?)?2)? | - | libpng(?: 2 0)? | libpng org pub png src libpng license
bsl-1.0 | boost software licen | (?:the )?boost software licen[cs]e(?: (?:version |v ?)?1(?: 0)?)? | - | bsl 1 0 | boost org license 1 0
unlicense | unlicense | (?:the )?unlicense (?:licen[cs]e|public domain)|released under the unlicense | unlicense | unlicense | unlicense org
wtfpl | public licen | do what the fuck you want to public licen[cs]e | wtfpl | wtfpl | wtfpl net
cc0-1.0 | cc0 | cc0(?: 1 0)?(?: universal)? (?:licen[cs]e|public domain dedication) | cc0 | cc0 1 0 | creativecommons org publicdomain zero
public-domain | public domain | (?:dedicated|released|placed) (?:in|in to|into|to) the public domain | - | public domain | creativecommons org publicdomain mark
cc-by-3.0 | cc by | cc by 3 0(?: licen[cs]e)? | - | cc by 3 0 | creativecommons org licenses by 3 0
cc-by-4.0 | cc by | cc by 4 0(?: licen[cs]e)? | - | cc by 4 0 | creativecommons org licenses by 4 0
cc-by-sa | cc by sa | cc by sa(?: [1234] [05])?(?: licen[cs]e)? | - | cc by sa [1234] [05] | creativecommons org licenses by sa
cc-by-nd | cc by nd | cc by nd(?: [1234] [05])?(?: licen[cs]e)? | - | cc by nd [1234] [05] | creativecommons org licenses by nd
cc-by-nc | cc by nc | cc by nc(?: [1234] [05])?(?: licen[cs]e)? | - | cc by nc [1234] [05] | creativecommons org licenses by nc
cc-by-nc-sa | cc by nc sa | cc by nc sa(?: [1234] [05])?(?: licen[cs]e)? | - | cc by nc sa [1234] [05] | creativecommons org licenses by nc sa
cc-by-nc-nd | cc by nc nd | cc by nc nd(?: [1234] [05])?(?: licen[cs]e)? | - | cc by nc nd [1234] [05] | creativecommons org licenses by nc nd
cc-by-full | creative commons attribution | creative commons attribution(?: [1234] [05])?(?: international| unported| generic)?(?: public)? licen[cs]e | - | - | creativecommons org licenses by
cc-by-sa-full | creative commons attribution | creative commons attribution share ?alike(?: [1234] [05])?(?: international| unported| generic)?(?: public)?(?: licen[cs]e)? | - | - | -
cc-by-nc-full | creative commons attribution | creative commons attribution non ?commercial(?: [1234] [05])?(?: international| unported| generic)?(?: public)?(?: licen[cs]e)? | - | - | -
cc-by-nc-nd-full | creative commons attribution | creative commons attribution non ?commercial no ?deriv(?:ative)?s(?: works)?(?: [1234] [05])?(?: international| unported)?(?: licen[cs]e)? | - | - | -
odbl | database licen | open (?:data commons open )?database licen[cs]e(?: (?:version |v ?)?1 0)? | odbl | odbl 1 0 | opendatacommons org licenses odbl
odc-by | data commons attribution | open data commons attribution licen[cs]e(?: (?:version |v ?)?1 0)? | - | odc by 1 0 | opendatacommons org licenses by
pddl | data commons public | open data commons public domain dedication(?: and)? licen[cs]e | - | pddl 1 0 | opendatacommons org licenses pddl
ofl-1.1 | open font licen | (?:the )?(?:sil )?open font licen[cs]e(?: (?:version |v ?)?1 [01])? | ofl(?: 1 1)? | ofl 1 [01] | scripts sil org ofl
psf | python software foundation licen | python software foundation licen[cs]e(?: (?:version |v ?)?2)? | psf | (?:psf|python) 2 0 | docs python org (?:[a-z0-9]+ ){0,3}license
php-3.01 | php licen | (?:the )?php licen[cs]e(?: (?:version |v ?)?3 01)? | - | php 3 01 | php net license 3 01
ruby | ruby licen | (?:the )?ruby licen[cs]e | - | ruby | ruby lang org [a-z]{2} about license
postgresql | postgresql licen | (?:the )?postgresql licen[cs]e | postgresql | postgresql | opensource org licenses? postgresql
openssl | openssl licen | (?:the )?openssl licen[cs]e | - | openssl | openssl org source license
ms-pl | microsoft public licen | microsoft public licen[cs]e | - | ms pl | opensource org licenses? ms pl
ms-rl | microsoft reciprocal licen | microsoft reciprocal licen[cs]e | - | ms rl | opensource org licenses? ms rl
upl-1.0 | universal permissive licen | universal permissive licen[cs]e(?: (?:version |v ?)?1 0)? | upl | upl 1 0 | opensource org licenses? upl
ecl-2.0 | educational community licen | educational community licen[cs]e(?: (?:version |v ?)?2 0)? | - | ecl 2 0 | opensource org licenses? ecl 2 0
afl-3.0 | academic free licen | academic free licen[cs]e(?: (?:version |v ?)?[123] [01])? | - | afl [123] [01] | opensource org licenses? afl 3 0
osl-3.0 | open software licen | open software licen[cs]e(?: (?:version |v ?)?[123] [01])? | - | osl [123] [01] | opensource org licenses? osl 3 0
ncsa | illinois | university of illinois ncsa open source licen[cs]e | - | ncsa | opensource org licenses? uoi ncsa
sspl-1.0 | server side public licen | server side public licen[cs]e(?: (?:version |v ?)?1)? | sspl | sspl 1 0 | mongodb com licensing server side public license
busl-1.1 | business source licen | business source licen[cs]e(?: (?:version |v ?)?1 [01])? | busl|bsl 1 1 | busl 1 1 | mariadb com bsl11
elastic-2.0 | elastic licen | (?:the )?elastic licen[cs]e(?: (?:version |v ?)?2(?: 0)?)? | - | elastic 2 0 | elastic co licensing elastic license
"""
# Sentences of license texts and of the notices they ask for.  label | words
SENTENCES = """
mit | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit | the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
mit | to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software
x11 | except as contained in this notice the name of (?:[a-z0-9]+ ){1,12}shall not be used in advertising or otherwise to promote the sale
ncsa | to deal with the software without restriction including without limitation the rights
isc | permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies
0bsd | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided as is
hpnd | permission to use copy modify and distribute this software and its documentation for any purpose and without fee is hereby granted
postgresql | permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted
bsd | redistribution and use in source and binary forms with or without modification are permitted
bsd | redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
bsd | redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer
bsd-2-clause | the views and conclusions contained in the software and documentation are those of the authors
bsd-3-clause | (?:neither the name|the names?) of (?:[a-z0-9]+ ){1,16}(?:may|nor the names of its contributors may) (?:not )?be used to endorse or promote products derived from this software
bsd-4-clause | all advertising materials mentioning features or use of this software must display the following acknowledge?ment
apache-2.0 | licensed under the apache license version 2 0 the license you may not use (?:this|these) (?:[a-z0-9]+ ){1,4}except in compliance with the license
apache-2.0 | licensed to the apache software foundation asf under one or more contributor license agreements
apache-2.0 | each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license
apache-2.0 | unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis
apache-2.0 | apache license version 2 0 january 2004
apache-1.1 | this product includes software developed by the apache software foundation http www apache org
gpl | this program is free software you can redistribute it and or modify it under the terms of the gnu general public license
gpl | you should have received a copy of the gnu general public license along with
gpl | the licenses for most software (?:and other practical works )?are designed to take away your freedom to share and change
gpl | this general public license applies to most of the free software foundation s software
gpl-1.0 | gnu general public license version 1 february 1989
gpl-2.0 | gnu general public license version 2 june 1991
gpl-2.0 | under the terms of the gnu general public license (?:as published by the free software foundation )?(?:either )?version 2
gpl-3.0 | gnu general public license version 3 29 june 2007
gpl-3.0 | the gnu general public license is a free copyleft license for software and other kinds of works
gpl-3.0 | under the terms of the gnu general public license (?:as published by the free software foundation )?(?:either )?version 3
lgpl | this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license
lgpl | you should have received a copy of the gnu (?:lesser|library) general public license along with
lgpl-2.0 | gnu library general public license version 2 june 1991
lgpl-2.1 | gnu lesser general public license version 2 1 february 1999
lgpl-3.0 | gnu lesser general public license version 3 29 june 2007
lgpl-3.0 | this version of the gnu lesser general public license incorporates the terms and conditions of version 3
agpl-3.0 | gnu affero general public license version 3 19 november 2007
agpl-3.0 | you should have received a copy of the gnu affero general public license along with
agpl-3.0 | specifically designed to ensure cooperation with the community in the case of network server software
gfdl | permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license
gfdl | the purpose of this license is to make a manual textbook or other functional and useful document free
mpl-1.1 | the contents of this file are subject to the mozilla public license version 1 1
mpl-2.0 | this source code form is subject to the terms of the mozilla public license v 2 0
mpl-2.0 | if a copy of the mpl was not distributed with this file you can obtain one at
epl | the accompanying program is provided under the terms of this eclipse public license
epl | this program and the accompanying materials are made available under the terms of the eclipse public license
cddl | the contents of this file are subject to the terms of the common development and distribution license
cpl-1.0 | the accompanying program is provided under the terms of this common public license
artistic-1.0 | the intent of this document is to state the conditions under which a package may be copied
artistic-2.0 | this license establishes the terms under which a given free software package may be copied modified distributed and or redistributed
zlib | this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software
zlib | the origin of this software must not be misrepresented you must not claim that you wrote the original software
zlib | altered source versions must be plainly marked as such and must not be misrepresented as being the original software
bsl-1.0 | permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license
unlicense | this is free and unencumbered software released into the public domain
unlicense | anyone is free to copy modify publish use compile sell or distribute this software
wtfpl | everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed
wtfpl | you just do what the fuck you want to
cc0-1.0 | the person who associated a work with this deed has dedicated the work to the public domain
cc0-1.0 | (?:has|have) waived all copyright and related or neighboring rights
cc-by-4.0 | to be bound by the terms and conditions of this creative commons attribution 4 0 international public license
cc-by-sa | to be bound by the terms and conditions of this creative commons attribution sharealike 4 0 international public license
cc-by-nc | to be bound by the terms and conditions of this creative commons attribution noncommercial 4 0 international public license
ofl-1.1 | this font software is licensed under the sil open font license
ofl-1.1 | permission is hereby granted free of charge to any person obtaining a copy of the font software
psf | psf hereby grants licensee a nonexclusive royalty free world wide license
psf | this license agreement is between the python software foundation psf and the individual or organization
php-3.01 | this product includes php software freely available from
openssl | this product includes software developed by the openssl project for use in the openssl toolkit
ms-pl | this license governs use of the accompanying software if you use the software you accept this license
upl-1.0 | subject to the condition set forth below permission is hereby granted to any person obtaining a copy of this software associated documentation and or data
eupl | this european union public licence the eupl applies to the work
sspl-1.0 | if you make the functionality of the program or a modified version available to third parties as a service
busl-1.1 | the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work
elastic-2.0 | you may not provide the software to third parties as a hosted or managed service
odbl | this (?:[a-z0-9]+ ){1,8}is made available under the open database license
beerware | as long as you retain this notice you can do whatever you want with this stuff
json | the software shall be used for good not evil
ijg | this software is based in part on the work of the independent jpeg group
unicode | permission is hereby granted free of charge to any person obtaining a copy of the unicode data files
w3c | by obtaining(?: using and or copying)? this work you the licensee agree that you have read understood and will comply with the following terms
proprietary | proprietary and confidential
proprietary | unauthorized copying of this file via any medium is strictly prohibited
"""
#: Words before a license's name that make a notice of it.
NOTICE = "(?:(?:licen[cs]ed|released|distributed|available|published|provided|covered|redistribute) (?:[a-z0-9]+ ){0,6})?under (?:(?:the )?terms (?:and conditions )?of )?(?:the |an? )?(?:%s)(?: licen[cs]e)?|licen[cs]e(?:d| is| type)? (?:%s)"
#: Form: priority and score.
FORMS = {"address": (5, 0.95), "sentence": (4, 0.95), "notice": (3, 0.9), "tag": (2, 0.8), "name": (1, 0.7)}
# The base phrases and labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
# Every rule's match holds a word that begins with one of these, so that other
# texts stop here.  ~ stands for what parts words, = for the same or nothing, _ for its first sign.
GATE_WORDS = """
advertising affero afl agpl anyone~is apache artistic asl~2
boost bsd bsl busl
cc0 cc~by cddl conclusions contained~in~this cpl creativecommons creative~commons
data~commons deal~(?:in|with)~the deed~has
ecl eclipse elastic endorse epl eupl
fdl fuck functionality~of
gfdl gnu_ good~not gpl
hereby~grant hosted~or
intent~of
jpeg
lgpl libpng licen
mariadb misrepresented mit~0 mozilla mpl ms~[pr]l
ncsa network~server no~attribution
odbl odc ofl opendatacommons opensource openssl osl
pddl permission~notice php proprietary psf public=domain python~2
redistribution retain~this
sil~org spdx sspl
unauthori[sz]ed under~(?:(?:the|an?)~)?(?:terms_|mit|isc|zlib|postgresql) unencumbered unlicen upl
waived warrant wtfpl
"""


def gate(words: str = GATE_WORDS) -> str:
    """One pattern of these words, those of the same first letter tried together and only where a word begins."""
    other = "[^a-z0-9]"
    rests: dict[str, list[str]] = {}
    for word in words.split():
        rests.setdefault(word[0], []).append(word[1:].replace("~", other + "+").replace("=", other + "*").replace("_", other))
    return "(?<![a-z0-9])(?:" + "|".join(f"{first}(?:{'|'.join(rest)})" for first, rest in rests.items()) + ")"


GATE = gate()
_APART = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def families() -> list[list[str | None]]:
    """label, keyword, names, short names, SPDX words, address of each family."""
    rows = [[part.strip() for part in line.split(" | ")] for line in FAMILIES.strip().splitlines()]
    return [[row[0].removesuffix("-full"), *[None if part == "-" else part for part in row[1:]]] for row in rows]


def rules() -> list[tuple[int, str, str, str, int, float]]:
    """(id, label, keyword, pattern, priority, score), the most telling first."""
    found: dict[str, list[tuple[str, str, str]]] = {form: [] for form in FORMS}
    for label, keyword, names, short, spdx, address in families():
        if address:
            found["address"].append((label, _literal(address), address))
        found["notice"].append((label, keyword, NOTICE % (names, names)))
        if short:  # each of its own, since a rule needs one keyword
            found["notice"] += [(label, _literal(words), NOTICE % (words, words)) for words in short.split("|")]
        if spdx and any(c.isdigit() for c in spdx) and " " in _literal(spdx):
            found["tag"].append((label, _literal(spdx), spdx))
        found["name"].append((label, keyword, names))
    for line in SENTENCES.strip().splitlines():
        label, words = line.split(" | ")
        found["sentence"].append((label, _literal(words), words))
    rows = [(label, key, f"(?<![^ ])(?:{words})(?![^ ])", *FORMS[form]) for form in FORMS for label, key, words in found[form]]
    return [(i, *row) for i, row in enumerate(rows)]


def _literal(pattern: str) -> str:
    """The longest run of plain letters in a pattern that every match holds."""
    depth, run, best, optional = 0, "", "", pattern + " "
    for i, c in enumerate(optional):
        depth += c == "("
        plain = depth == 0 and (c.isalnum() or c == " ") and optional[i + 1 : i + 2] not in ("?", "*", "{")
        run = run + c if plain else ""
        best = max(best, run.strip(), key=len)
        depth -= c == ")"
    return best


def _table() -> Column:
    """The rules as one constant array."""
    rows = [{"label": label, "key": key, "pattern": pattern, "priority": priority, "score": score} for _, label, key, pattern, priority, score in rules()]
    return F.from_json(F.lit(json.dumps(rows)), "array<struct<label: string, key: string, pattern: string, priority: int, score: double>>")


def _intervals(norm: Column, rule: Column) -> Column:
    """Where a rule's matches lie: array<struct<start, end, priority, label, score>>.

    Places are running sums of the lengths between and of the matches, over blocks of about
    the root of their number, so that a text with very many matches isn't quadratic.
    """
    gaps, found = F.split(norm, rule["pattern"], -1), F.regexp_extract_all(norm, rule["pattern"], F.lit(0))
    lengths = F.filter(F.zip_with(gaps, found, lambda g, m: F.struct(F.length(g).alias("gap"), F.length(m).alias("match"))), lambda x: x["match"].isNotNull())

    def blocks(items: Column) -> Column:
        width = F.ceil(F.sqrt(F.size(items).cast("double"))).cast("int")
        return F.transform(F.sequence(F.lit(0), F.size(items) - 1, width), lambda i: F.slice(items, i + 1, width))

    def starts(parts: Column) -> Column:
        """Where each block starts."""
        none = F.array().cast("array<int>")
        sums = F.transform(parts, lambda part: F.aggregate(part, F.lit(0), lambda at, x: at + x["gap"] + x["match"]))
        return F.aggregate(sums, F.struct(F.lit(0).alias("at"), none.alias("out")), lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])

    none = F.array().cast("array<struct<start:int,end:int,priority:int,label:string,score:double>>")

    def walk(part: Column, at: Column) -> Column:
        def step(acc: Column, x: Column) -> Column:
            start = acc["at"] + x["gap"]
            one = F.struct(start.alias("start"), (start + x["match"]).alias("end"), rule["priority"].alias("priority"), rule["label"].alias("label"), rule["score"].alias("score"))
            return F.struct((start + x["match"]).alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

        return F.aggregate(part, F.struct(at.alias("at"), none.alias("out")), step, lambda acc: acc["out"])

    def joined(items: Column) -> Column:
        return F.element_at(F.transform(F.array(blocks(items)), lambda parts: F.flatten(F.zip_with(parts, starts(parts), walk))), 1)

    return F.flatten(F.transform(F.array(lengths), lambda items: F.when(F.size(items) > 0, joined(items)).otherwise(none)))


def _surviving(intervals: Column) -> Column:
    """struct<labels, score> of the intervals that none of equal or higher priority holds.

    In the order of start, then longest, an interval lies in an earlier one if some end so
    far reaches its own; ends are kept by priority, so one pass is enough.
    """
    ordered = F.array_sort(F.transform(intervals, lambda x: F.struct(x["start"].alias("start"), (-x["end"]).alias("back"), (-x["priority"]).alias("rank"), x["label"].alias("label"), x["score"].alias("score"))))
    first = F.struct(F.array(*[F.lit(-1)] * len(FORMS)).alias("ends"), F.array().cast("array<string>").alias("labels"), F.lit(0.0).alias("score"))

    def step(acc, x):
        held = F.exists(F.slice(acc["ends"], -x["rank"], len(FORMS)), lambda end: end >= -x["back"])
        ends = F.transform(acc["ends"], lambda end, i: F.when(i == -x["rank"] - 1, F.greatest(end, -x["back"])).otherwise(end))
        return F.when(held, acc).otherwise(F.struct(ends.alias("ends"), F.array_union(acc["labels"], F.array(x["label"])).alias("labels"), F.greatest(acc["score"], x["score"]).alias("score")))

    return F.aggregate(ordered, first, step, lambda acc: F.struct(acc["labels"].alias("labels"), acc["score"].alias("score")))


def _spdx(norm: Column) -> Column:
    """Labels of the members of all SPDX expressions of a text.

    What follows "SPDX-License-Identifier" is split at or, and, with; members are the leading
    parts that are an identifier, and the identifier that the part after these begins with.
    """
    ids = [(label, spdx) for label, _, _, _, spdx, _ in families() if spdx]
    item = "|".join(sorted((spdx for _, spdx in ids), key=len, reverse=True)) + "|[a-z0-9]+(?: [a-z0-9]+){0,3} exception(?: [0-9]+){0,2}"
    table = F.from_json(F.lit(json.dumps([{"label": label, "pattern": f"^(?:{spdx})$"} for label, spdx in ids])), "array<struct<label: string, pattern: string>>")
    tails = F.slice(F.split(norm, "(?<![^ ])spdx licen[cs]e identifiers? "), 2, 1 << 30)
    parts = F.transform(tails, lambda tail: F.split(F.replace(tail, F.lit(" or later"), F.lit("")), " (?:or|and|with) "))  # "or later" is no member
    whole = lambda part: F.array_position(F.transform(part, lambda p: p.rlike(f"^(?:{item})$")), F.lit(False))
    members = F.flatten(F.transform(parts, lambda part: F.when(whole(part) > 0, F.slice(part, F.lit(1), whole(part).cast("int"))).otherwise(part)))
    known = F.transform(members, lambda m: F.regexp_extract(m, f"^({item})(?![^ ])", 1))
    labels = F.transform(F.filter(F.array_distinct(known), lambda m: m != ""), lambda m: F.get(F.filter(table, lambda f: F.rlike(m, f["pattern"])), F.lit(0))["label"])
    return F.when(norm.contains("spdx licen"), F.filter(labels, lambda x: x.isNotNull()))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    low = F.translate(F.coalesce(F.col("text"), F.lit("")), _UPPER, _LOWER)
    rows = docs.select("doc_id", low.alias("low"))
    rows = rows.select("doc_id", "low", F.trim(F.regexp_replace("low", _APART, " ")).alias("words"))
    n_words = F.when(F.col("words") == "", 0).otherwise(F.length("words") - F.length(F.replace("words", F.lit(" "), F.lit(""))) + 1)
    rows = rows.select("doc_id", n_words.cast("long").alias("n_words"), F.when(F.col("low").rlike(GATE), F.col("words")).alias("norm"))
    phrase = f"(?<![^ ])(?:{'|'.join(BASE)})(?![^ ])"
    places = F.when(F.col("norm").isNotNull(), F.regexp_extract_all("norm", F.lit(phrase), F.lit(0)))
    hits = F.filter(_table(), lambda r: F.contains(F.col("norm"), r["key"]))
    found = F.when(F.col("norm").isNotNull(), _surviving(F.flatten(F.transform(hits, lambda r: _intervals(F.col("norm"), r)))))
    rows = rows.select("*", places.alias("places"), found.alias("found"), _spdx(F.col("norm")).alias("spdx"))
    count = lambda c: F.regexp_count(c, F.lit("[^ ]+"))
    some = F.size(F.coalesce("places", F.array().cast("array<string>"))) > 0
    before = count(F.element_at(F.split("norm", phrase, 2), 1))
    after = count(F.element_at(F.split("norm", phrase, -1), -1)) + count(F.element_at("places", -1))
    label = F.create_map(*[F.lit(x) for pair in BASE.items() for x in pair])
    none = F.array().cast("array<string>")
    base = F.when(some, F.array_distinct(F.transform("places", lambda p: label[p]))).otherwise(none)
    return rows.select(
        "doc_id",
        "n_words",
        F.when(some, F.size("places")).otherwise(0).cast("long").alias("n_base"),
        F.when(some, before.cast("long")).alias("first_word"),
        F.when(some, F.col("n_words") - after).alias("last_word"),
        F.concat_ws(",", F.array_sort(base)).alias("base_labels"),
        F.concat_ws(",", F.array_sort(F.array_union(F.array_union(base, F.coalesce(F.col("found")["labels"], none)), F.coalesce("spdx", none)))).alias("labels"),
        F.when(F.size("spdx") > 0, 1.0).otherwise(F.coalesce(F.col("found")["score"], F.lit(0.0))).alias("score"),
    )
