import hashlib
import random
import time
import re

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from inkveil.llm import bpe, html_extract, langid, licenses, quality, secrets

RANKS = bpe.read_ranks(open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb").read())


# ---------------------------------------------------------------- op1


def page(body, head="<title>T</title><script>var a='<p>no</p>';</script>"):
    return f"<!DOCTYPE html><html><head>{head}</head><body>{body}</body></html>"


@pytest.mark.parametrize("body, text", [
    ("<nav><a href=/>Home</a></nav><article><h1>A &amp; B</h1><p>one\n two<b>x</b> three</p><div class='ad'>buy</div><p>end.</p></article><footer>&copy; us</footer>", "A & B one twox three end."),
    ("<header>Site</header><main><p>text that is long enough here</p></main><aside>more</aside><form><input>go</form>", "text that is long enough here"),
    ("<article><p>first words of it<br>second line<p>third</article><section id=comments><article><p>I disagree</p></article></section>", "first words of it second line third"),
    ("<div id='sidebar'>links</div><div class='post-content'><p>The body of the text has quite a few words.</p></div><div class='cookie-notice'>We use cookies</div>", "The body of the text has quite a few words."),
    ("<article><p>caf&eacute; &#x41;&nbsp;z</p><!-- no --><p hidden>no</p></article>", "café A z"),
    ("<div class=ad>open advert<article><p>still found</p></article>", "still found"),
    ("<article><p title='a > b'>kept</p><style>p{}</style></article>", "kept"),
])
def test_extract(body, text):
    assert html_extract.extract(page(body)) == text


def test_extract_scan_is_best_run():
    rng = random.Random(3)
    for _ in range(30):
        parts = [rng.choice(["<p>", "<div>", "</div>", "some words here", "word", "<a href=x>link</a>", "<hr>"]) for _ in range(25)]
        row = list(html_extract.items("".join(parts)))
        score = [html_extract.WEIGHTS.get(k, html_extract._DEFAULT[k.partition(":")[0]]) * (len(t.split()) if k[0] == "w" else 1) for k, t in row]
        best = max((sum(score[i:j]), -i, j) for i in range(len(score) + 1) for j in range(i, len(score) + 1))
        got = html_extract.extract("".join(parts)).split()
        if best[0] > 0:
            runs = {tuple("".join(t for _, t in row[i:j]).split()) for i in range(len(score) + 1) for j in range(i, len(score) + 1) if abs(sum(score[i:j]) - best[0]) < 1e-9}
            assert tuple(got) in runs
        else:
            assert got == []


# ---------------------------------------------------------------- op2


def test_gradients():
    network = langid.Network(["a", "b", "c"])
    rng = np.random.default_rng(1)
    x = rng.integers(97, 110, (9, 6)).astype(np.int32)
    x[6:, 2] = langid.PAD
    label = np.array([0, 1, 2, 1, 0, 2])
    _, grads = network.gradients(x, label)
    for name, place in (("xf", (3, 100)), ("uf", (2, 3)), ("ub", (9, 2)), ("cb", (1, 1)), ("v", (1, 4)), ("b", (2, 0))):
        old = network.p[name][place]
        losses = []
        for step in (0.01, -0.01):
            network.p[name][place] = old + step
            losses.append(network.gradients(x, label)[0])
        network.p[name][place] = old
        assert (losses[0] - losses[1]) / 0.02 == pytest.approx(float(grads[name][place]), rel=0.05, abs=2e-5)


def test_windows_cover_text():
    raw = [b"a" * n for n in (0, 1, 127, 128, 129, 1000)]
    x, owner, sizes = langid.windows(raw)
    assert [int((x[:, owner == i] != langid.PAD).sum()) for i in range(len(raw))] == [len(r) for r in raw] == sizes.tolist()


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    network = langid.learn(docs)
    rows = langid.predict(docs, network).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(rows) > 150
    assert sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)
    assert len(network.label("der und é")) == len("der und é".encode())


def test_pool_is_mean_of_positions(spark):
    network = langid.Network(["a", "b"], seed=2)
    texts = ["abc" * 100, "z", "é" * 77]
    pooled = network.pool(texts)
    for text, row in zip(texts, pooled, strict=True):
        prob = network.probabilities(langid.windows([text.encode()])[0])
        flat = prob.transpose(2, 0, 1).reshape(-1, 2)[: len(text.encode())]
        assert row == pytest.approx(flat.mean(0), rel=1e-4)


# ---------------------------------------------------------------- op3


def der(tag, body):
    size = len(body).to_bytes((len(body).bit_length() + 7) // 8 or 1, "big")
    return bytes([tag]) + (bytes([len(body)]) if len(body) < 128 else bytes([0x80 | len(size)]) + size) + body


RSA = der(0x30, b"".join(der(2, bytes([0] if i == 0 else [7] * n)) for i, n in enumerate((1, 129, 3, 128, 65, 65, 65, 65, 65))))
PKCS8 = der(0x30, der(2, b"\0") + der(0x30, der(6, b"\x2b\x65\x70")) + der(4, der(4, b"k" * 32)))


def field(x):
    return len(x).to_bytes(4, "big") + x


SSH = b"openssh-key-v1\0" + field(b"none") + field(b"none") + field(b"") + (1).to_bytes(4, "big") + field(field(b"ssh-ed25519") + field(b"p" * 32)) + field(b"q" * 64)


def b64(data):
    import base64

    return base64.b64encode(data).decode()


def jwt(header):
    import base64
    import json

    return ".".join(base64.urlsafe_b64encode(json.dumps(p).encode()).rstrip(b"=").decode() for p in (header, {"sub": "1"})) + ".c2ln"


SEALED = der(0x30, der(0x30, der(6, bytes.fromhex("2a864886f70d01050d")) + der(0x30, b"")) + der(4, b"z" * 48))
DSA = der(0x30, der(2, b"\0") + b"".join(der(2, b"\x05" * n) for n in (64, 20, 64, 64, 20)))
SEC1 = der(0x30, der(2, b"\1") + der(4, b"e" * 32))


def wrapped(digits, joint, width=64):
    return joint.join(digits[i : i + width] for i in range(0, len(digits), width))


@pytest.mark.parametrize("joint", ["", "\n", "\r\n", "\n    ", "\\n", "\\r\\n", " \n\t"])
def test_key_spans_end_where_keys_end(joint):
    """Keys of every kind in random surroundings: the spans are the keys and nothing else."""
    rng = random.Random(repr(joint))
    kinds = [(k, "der_key") for k in (RSA, PKCS8, SEALED, DSA, SEC1)] + [(SSH, "openssh_key")]
    for data, kind in kinds * 4:
        safe = rng.random() < 0.5
        key = wrapped(b64(data).translate(str.maketrans("+/", "-_")) if safe else b64(data), joint)
        before = rng.choice(["", "some words ", "path/", "x=", "-----BEGIN KEY-----\n", "é: \"", "keys:\n  - "])
        after = rng.choice(["", " and more", "\nHello\nworld\nand", "\n-----END KEY-----", '"', "\\nword"])
        text = before + key + after
        found = [s for s in secrets.spans(text) if s[2] not in secrets.KINDS[:3]]
        assert [(text[a:b], k) for a, b, k in found] == [(key, kind)], text
        assert secrets.mask(text, found) == before + "[SECRET]" + after
        run = "".join(rng.choice("0123456789abcdef") for _ in range(rng.randint(0, 5)))
        digits = (data.hex().upper if rng.random() < 0.5 else data.hex)()
        found = [s for s in secrets.spans(f"{run}{digits} end") if s[2] == kind]
        assert found == [(len(run), len(run) + 2 * len(data), kind)]


def test_no_key_in_random_runs():
    rng = random.Random(5)
    digits = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    for _ in range(300):
        text = "".join(rng.choice(digits) for _ in range(rng.randint(20, 400)))
        assert not [s for s in secrets.spans(text) if s[2] not in secrets.KINDS[:3]]
    for cut in (10, 40, 80):  # a key that isn't whole, or whose lengths don't add up
        assert not [s for s in secrets.spans(b64(RSA)[:-cut]) if s[2] == "der_key"]
    start = time.perf_counter()
    assert not [s for s in secrets.spans("MIIE" * 60_000) if s[2] == "der_key"]
    assert time.perf_counter() - start < 5


def test_token_headers_with_white_space():
    import base64

    part = lambda t: base64.urlsafe_b64encode(t.encode()).rstrip(b"=").decode()
    for head in ('{"alg":"HS256"}', '{ "alg" : "HS256" }', '{\n "alg": "HS256"}', ' {"alg":"HS256"}', '\t{"alg":"HS256"}'):
        token = f"{part(head)}.{part('{}')}.c2ln"
        assert [(a, b) for a, b, k in secrets.spans(f"a {token}, b") if k == "signed_token"] == [(2, 2 + len(token))]


def test_structural_secrets():
    kinds = lambda t: [k for _, _, k in secrets.spans(t) if k not in secrets.KINDS[:3]]
    assert kinds(f"é {b64(RSA)} x") == ["der_key"]
    assert kinds(b64(PKCS8)) == ["der_key"]
    assert kinds(b64(SSH)) == ["openssh_key"]
    assert kinds(PKCS8.hex()) == ["der_key"]
    assert kinds(f"Bearer {jwt({'alg': 'HS256'})}") == ["signed_token"]
    assert kinds(jwt({"typ": "JWT"})) == []
    assert kinds(b64(RSA[:-4])) == []  # nested lengths don't add up
    assert kinds(b64(b"0" * 90)) == []
    start, end, _ = secrets.spans(f"é {b64(PKCS8)}")[0]
    assert (start, end) == (2, 2 + len(b64(PKCS8)))


def brute_base(text):
    out = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        if len(m[2]) >= 12:
            out.append((m.start(), 0, m.end(), "assign"))
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(out))


def test_secret_base_layer(spark):
    rng = random.Random(5)
    parts = ["password", "PassWd=", "api_key: ", "apikey", "token='", "secret\" = \"", "abcdef0123456789", "AKIA", "ABCD1234EFGH5678", " ", ": ", "=", "é", "0f" * 9, "xyz_long_value-1", "ſecret=abcdefghijklmn", "\n"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(600)] + ["token = \"" + "a1" * 20 + '"', "AKIA" + "A" * 14, "AKIA" + "A" * 13]
    rows = secrets.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for r in rows:
        want = brute_base(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest(), texts[r.doc_id]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(want.count(f"{k}:") for k in ("assign", "access", "hex"))
        assert {s for s in want.split(",") if s} <= set(r.spans.split(","))


def test_mask():
    text = "x token=abcdefghijklmnop y"
    assert secrets.mask(text, secrets.spans(text)) == "x [SECRET] y"


# ---------------------------------------------------------------- op5


def brute_quality(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered), n < 50 or 100 * len(covered) > 50 * n


def test_quality_measures(spark):
    rng = random.Random(8)
    parts = ["a", "b", "word", "é\x1c", "#", "|", "\n", " ", "\t", " ", "the the the ", "\r\n", "line one\n"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 90))) for _ in range(400)] + [" ".join("abcdefgh"[i % 8] + "klmnopqr"[i // 8] + "x" for i in range(60))]
    for r in quality.judge(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute_quality(texts[r.doc_id]), repr(texts[r.doc_id])
        assert not (r.kept and r.base_failed)
    assert r.doc_id != 400 or r.kept


def test_quality_keeps_labelled_good(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = quality.judge(docs).join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").where("not base_failed").collect()
    assert all(r.kept for r in rows if r.quality == 1)
    assert not any(r.kept for r in rows if r.quality == 0)


def test_ablations(spark):
    policy = quality.Policy("p", 1, ("few_words", "symbols"))
    few, sym, other = (quality.BIT[r] for r in ("few_words", "symbols", "digits"))
    rows = spark.createDataFrame([(x,) for x in (0, few, few, sym, few | sym, other, other | sym)], "failed_bits long")
    got = {r.rule: tuple(r)[1:] for r in quality.ablations(rows, policy).collect()}
    assert got == {"few_words": (3, 2, 4), "symbols": (3, 2, 4)}
    assert {tuple(r)[1:] for r in quality.ablations(rows.limit(0), policy).collect()} == {(0, 0, 0)}


# ---------------------------------------------------------------- op6


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(RANKS, public_tokenizers.PATTERN), tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def test_bpe_against_library(encoder):
    ours, library = encoder
    rng = random.Random(1)
    alphabet = "abcdeéñ 中文　\x1c\x85\xa0\n\t 😀0123'sS.,!ⅷ½"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    texts += ["a" * n for n in range(1, 600, 13)] + ["ab" * 700, " " * 3000, "".join(rng.choice("etaoinshr") for _ in range(20000)), "", None]
    ids, counts = ours.encode(texts)
    for text, part, back in zip(texts, np.split(ids, np.cumsum(counts)[:-1]), ours.decode(ids, counts), strict=True):
        assert part.tolist() == library.encode_ordinary(text or "")
        assert back == (text or "").encode()


def test_bpe_cache_overflow(encoder, monkeypatch):
    ours, library = encoder
    monkeypatch.setattr(bpe, "CACHE", 10)
    for text in ("one two three four five six seven eight", "nine ten eleven twelve thirteen fourteen"):
        assert ours.encode([text])[0].tolist() == library.encode_ordinary(text)


def test_bpe_rows(spark, encoder):
    docs = spark.createDataFrame([(1, "héllo world"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in bpe.encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=True).collect()}
    ids = encoder[1].encode_ordinary("héllo world")
    assert got[1].ids == ids and got[1].n_tokens == len(ids)
    assert got[1].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    assert got[1].decoded_sha256 == hashlib.sha256("héllo world".encode()).hexdigest()
    assert got[2].n_tokens == 0 and got[2].ids_sha256 == hashlib.sha256(b"").hexdigest()


# ---------------------------------------------------------------- op7


def test_article_stays_whole():
    rules = "<div class=content><p>Alpha beta.</p>" + "<br><hr>" * 6 + "<p>Gamma delta epsilon zeta eta theta.</p></div>"
    assert html_extract.extract(rules) == "Alpha beta. Gamma delta epsilon zeta eta theta."
    links = "".join(f"<li><a href=/{i}>link {i}</a></li>" for i in range(8))
    page = f"<nav><a href=/>Home</a></nav><article><p>The start of an article.</p><ul>{links}</ul><p>End of the article.</p></article><footer>All rights</footer>"
    assert html_extract.extract(page) == "The start of an article. " + " ".join(f"link {i}" for i in range(8)) + " End of the article."
    topic = "<article><p>Some text that begins here.</p><section class='related-work'><p>Others wrote of it.</p></section><div class='related-posts'>More</div><p>It ends.</p></article>"
    assert html_extract.extract(topic) == "Some text that begins here. Others wrote of it. It ends."


@pytest.mark.parametrize("page", ["<span>" * 100_000 + "</p>" * 100_000 + "x", "<p><table>" + "<span>" * 50_000 + "<hr>" * 50_000 + "x", "<ul>" + "<li><a>" * 50_000])
def test_page_parsing_is_linear(page):
    start = time.perf_counter()
    html_extract.extract(page)
    assert time.perf_counter() - start < 8


def sample(pattern, rng):
    """A random text that the pattern matches."""
    import re._constants as c
    import re._parser as parser

    def draw(items):
        out = ""
        for op, arg in items:
            if op is c.LITERAL:
                out += chr(arg)
            elif op is c.IN:
                kind, value = rng.choice(arg)
                out += chr(value if kind is c.LITERAL else rng.randint(*value))
            elif op is c.MAX_REPEAT:
                out += "".join(draw(arg[2]) for _ in range(rng.randint(arg[0], min(arg[1], arg[0] + 3))))
            elif op is c.SUBPATTERN:
                out += draw(arg[3])
            elif op is c.BRANCH:
                out += draw(rng.choice(arg[1]))
            else:
                assert op is c.ASSERT_NOT
        return out

    return draw(parser.parse(pattern))


def test_license_rules():
    """Every text that a rule matches passes the gate and holds the rule's keyword."""
    rules, rng = licenses.rules(), random.Random(3)
    assert len(rules) > 200
    for _, label, key, pattern, _, _ in rules:
        assert len(key) >= 3, label
        for _ in range(30):
            text = sample(pattern, rng)
            assert re.search(pattern, text) and key in text and re.search(licenses.GATE, text), (label, text)


def brute_labels(text):
    """Labels and score: every pair of intervals is compared, SPDX expressions are read member by member."""
    low = text.lower()
    norm = " ".join(re.findall("[a-z0-9\x80-\U0010ffff]+", low))
    if not re.search(licenses.GATE, low):
        return set(), 0.0
    found = [(m.start(), -m.end(), -priority, label, score) for _, label, key, pattern, priority, score in licenses.rules() if key in norm for m in re.finditer(pattern, norm)]
    left = [x for x in found if not any(y < x and y[0] <= x[0] and y[1] <= x[1] and y[2] <= x[2] for y in found)]
    labels, score = {x[3] for x in left}, max([x[4] for x in left], default=0.0)
    ids = [(label, spdx) for label, _, _, _, spdx, _ in licenses.families() if spdx]
    for tail in re.split(r"(?<![^ ])spdx license identifier ", norm)[1:]:
        while True:
            member = max((m.group() for _, spdx in ids if (m := re.match(f"(?:{spdx})(?![^ ])", tail))), key=len, default=None) or getattr(re.match(r"[a-z0-9]+(?: [a-z0-9]+){0,3} exception(?: [0-9]+){0,2}(?![^ ])", tail), "group", lambda: None)()
            if not member:
                break
            for label in [label for label, spdx in ids if re.fullmatch(spdx, member)][:1]:
                labels, score = labels | {label}, 1.0
            more = re.match("(?:or|and|with) ", tail[len(member) + 1 :])
            if not more:
                break
            tail = tail[len(member) + 1 + more.end() :]
    return labels, score


def test_license_labels_against_brute_force(spark):
    rng, rules = random.Random(11), licenses.rules()
    ids = [spdx for _, _, _, _, spdx, _ in licenses.families() if spdx]
    texts = []
    for i in range(160):
        parts = [sample(rng.choice(rules)[3], rng) if rng.random() < 0.6 else rng.choice(["some words", "Und so weiter.", "the", "the MIT", "License", "\n"]) for _ in range(rng.randint(1, 7))]
        if i % 4 == 0:
            members = [sample(rng.choice(ids), rng) for _ in range(rng.randint(1, 12))]
            parts.insert(rng.randint(0, len(parts)), "SPDX-License-Identifier: " + rng.choice([" OR ", " AND ", " with classpath exception 2 0 or "]).join(members))
        texts.append(rng.choice([" ", ", ", "; "]).join(parts))
    base = lambda t: set(filter(None, brute_license(t)[4].split(",")))
    for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect():
        labels, score = brute_labels(texts[r.doc_id])
        assert set(filter(None, r.labels.split(","))) == labels | base(texts[r.doc_id]), texts[r.doc_id]
        assert r.score == score, texts[r.doc_id]


def test_many_license_matches_in_one_text(spark):
    text = "under the MIT license, and " * 16_000
    start = time.perf_counter()
    row = licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (row.labels, row.n_base) == ("mit", 16_000)
    assert time.perf_counter() - start < 20


def brute_license(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    places = sorted((i, label) for phrase, label in licenses.BASE.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split())
    return len(words), len(places), places[0][0] if places else None, places[-1][0] if places else None, ",".join(sorted({p[1] for p in places}))


def test_license_base(spark):
    rng = random.Random(2)
    parts = ["GNU General", "public", "license", "License:", "apache-", "MIT", "CC-BY", "cc", "by", "é", "\n", ", ", " ", "0", "İ", "K"]
    texts = ["".join(rng.choice(parts) + rng.choice(["", " ", "-"]) for _ in range(rng.randint(0, 30))) for _ in range(500)]
    for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect():
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute_license(texts[r.doc_id]), texts[r.doc_id]
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
        assert 0 <= r.score <= 1


def test_license_labels(spark):
    cases = {
        "SPDX-License-Identifier: Apache-2.0 OR MIT": "apache-2.0,mit",
        "Licensed under the Apache License, Version 2.0.": "apache,apache-2.0",
        "GNU Lesser General Public License v2.1": "lgpl-2.1",
        "see https://creativecommons.org/licenses/by-sa/4.0/": "cc-by-sa",
        "under the BSD 3-Clause License": "bsd-3-clause",
        "das ist mit allem, apache helicopters": "",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\")": "mit",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that": "bsd",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.": "isc",
        "Apache-2.0": "apache-2.0",
        "it is licensed under MIT": "mit",
        "under the terms of the MPL 2.0": "mpl-2.0",
        "use it under the GPL": "gpl",
        "All rights reserved. Licensed to X": "",
        "SPDX-License-Identifier: " + " OR ".join(["BSD-3-Clause", "GPL-2.0-only WITH Classpath-exception-2.0"] * 40 + ["ISC"]) + " and more": "bsd-3-clause,gpl-2.0,isc",
    }
    got = {r.doc_id: r.labels for r in licenses.scan(spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")).collect()}
    assert got == dict(enumerate(cases.values()))


def test_license_is_native(spark):
    plan = licenses.scan(spark.createDataFrame([(1, "x")], "doc_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_too_many_languages_fail(spark, monkeypatch):
    monkeypatch.setattr(langid, "LANGUAGES", 2, raising=False)
    docs = spark.createDataFrame([(i, "some words", f"l{i % 3}") for i in range(60)], "doc_id long, text string, lang string")
    with pytest.raises(ValueError, match="more than 2"):
        langid.learn(docs)
