"""Names in text: exact dictionary matches and near matches, over byte texts."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np

from .text import float32

ALIAS = "Entity_"
#: Aliases by letters reach as far as ZZ.
LEGACY = 26 + 26 * 26
_FOLD = bytes(i + 32 if 65 <= i <= 90 else i if i > 127 or chr(i).isalnum() or chr(i) in " .-'" else 0 for i in range(256))
_FREE = frozenset(chr(i) for i in range(128) if not chr(i).isalnum())


def fold(text: str) -> str:
    """A byte text, case folded; the ASCII characters that names don't tell apart are one."""
    return text.encode("latin-1").translate(_FOLD).decode("latin-1")


def alias(group: int) -> str:
    return f"{ALIAS}{group + 1}"


def legacy_alias(group: int) -> str | None:
    """Entity_A ... Entity_ZZ of the first 702 groups."""
    if group < 26:
        return ALIAS + chr(65 + group)
    if group < LEGACY:
        return ALIAS + chr(65 + (group - 26) // 26) + chr(65 + (group - 26) % 26)
    return None


@dataclass(frozen=True)
class Span:
    start: int
    end: int
    index: int
    confidence: float | None = None


def greedy(spans: Iterable[Span]) -> list[Span]:
    """Leftmost, then longest, without overlap."""
    taken, end = [], 0
    for s in sorted(spans, key=lambda s: (s.start, s.start - s.end)):
        if s.start >= end:
            taken.append(s)
            end = s.end
    return taken


class Dictionary:
    """Finds any of many names, whole words only, and replaces them."""

    def __init__(self, names: list[str], replacements: list[str]):
        """Names and replacements are byte texts; of names that fold alike the last counts."""
        self.replacements = replacements
        self.names = {fold(name): i for i, name in enumerate(names) if name}
        self.longest = max(map(len, self.names), default=0)
        self._automaton, self._pattern = None, None
        if not self.names:
            return
        try:
            import ahocorasick
        except ImportError:
            # every length at every word start: leftmost-longest needs all candidates
            self._lengths = sorted({len(n) for n in self.names}, reverse=True)
            return
        self._automaton = ahocorasick.Automaton()
        for name, i in self.names.items():
            self._automaton.add_word(name, (len(name), i))
        self._automaton.make_automaton()

    def _candidates(self, folded: str) -> Iterable[Span]:
        if self._automaton is not None:
            for last, (size, i) in self._automaton.iter(folded):
                yield Span(last + 1 - size, last + 1, i)
        else:
            for start in range(len(folded)):
                if start == 0 or folded[start - 1] in _BOUNDS:
                    for size in self._lengths:
                        if (i := self.names.get(folded[start : start + size])) is not None and start + size <= len(folded):
                            yield Span(start, start + size, i)

    def find(self, text: str) -> list[Span]:
        if not self.names:
            return []
        whole = (s for s in self._candidates(fold(text)) if (s.start == 0 or text[s.start - 1] in _FREE) and (s.end == len(text) or text[s.end] in _FREE))
        return greedy(whole)

    def replace(self, text: str, spans: list[Span] | None = None) -> str:
        out, last = [], 0
        for s in self.find(text) if spans is None else spans:
            out += [text[last : s.start], self.replacements[s.index]]
            last = s.end
        return "".join([*out, text[last:]]) if out else text


_BOUNDS = frozenset("\0 .-'")


def forward(names: list[str], groups: list[int] | None = None) -> Dictionary:
    groups = list(range(len(names))) if groups is None else groups
    return Dictionary(names, [alias(g) for g in groups])


def reverse(names: list[str], groups: list[int] | None = None, first_name: bool = False) -> Dictionary:
    """Aliases, by number and by letters, back to names.

    A group's last name counts; ``first_name`` takes its first instead.
    """
    groups = list(range(len(names))) if groups is None else groups
    back: dict[str, str] = {}
    for name, group in zip(names, groups, strict=True):
        for key in (alias(group), legacy_alias(group)):
            if key and not (first_name and key in back):
                back[key] = name
    return Dictionary(list(back), list(back.values()))


# ---------------------------------------------------------------- near matches

_FUZZY = re.compile("[A-Za-z0-9']+")
_SPACES = re.compile("[ \t\r\n]+")
_DROP = {ord(c): None for c in ".,'\"!?;:()[]{}"} | {i: i + 32 for i in range(65, 91)}


def normal(text: str) -> str:
    return _SPACES.sub(" ", text.translate(_DROP)).strip(" ")


def trigrams(text: str) -> int:
    """128 bits, one for each hashed run of three bytes; all bits for shorter texts."""
    if len(text) < 3:
        return (1 << 128) - 1
    data = text.encode("latin-1")
    bits = 0
    for a, b, c in zip(data, data[1:], data[2:], strict=False):
        bits |= 1 << ((31 * a + 7 * b + c) & 127)
    return bits


def raw_trigrams(window: str) -> int:
    """The same of a raw window: letters, digits and single spaces, at most 64 of them."""
    clean = re.sub("[^A-Za-z0-9 \t]", "", window)
    clean = re.sub("[ \t]+", " ", clean).lstrip(" ").translate(_DROP)[:64]
    return trigrams(clean) if len(window) >= 3 else (1 << 128) - 1


def edits(a: str, b: str) -> int:
    """Edit distance, column by column in the bits of one integer."""
    if not a:
        return len(b)
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    top, plus, minus, score = 1 << (len(a) - 1), (1 << len(a)) - 1, 0, len(a)
    for c in b:
        same = where.get(c, 0)
        diagonal = (((same & plus) + plus) ^ plus) | same | minus
        up, down = minus | ~(diagonal | plus), plus & diagonal
        score += bool(up & top) - bool(down & top)
        up, down = up << 1 | 1, down << 1
        plus, minus = (down | ~(diagonal | up)) & (2 * top - 1), up & diagonal & (2 * top - 1)
    return score


#: Bytes of texts that are worked on together.
RUN = 1 << 20
_KIND = np.zeros(256, np.uint8)  # 1: letter or digit, 2: space or tab
_KIND[[*range(48, 58), *range(65, 91), *range(97, 123)]] = 1
_KIND[[32, 9]] = 2
_LOWER = np.arange(256, dtype=np.int64)
_LOWER[65:91] += 32
_LOWER[9] = 32
_PLAIN = np.ones(256, np.uint8)  # 0: dropped from a normal form, 2: white space
_PLAIN[[ord(c) for c in ".,'\"!?;:()[]{}"]] = 0
_PLAIN[[32, 9, 10, 13]] = 2


def _kept(kind: np.ndarray) -> np.ndarray:
    """Which bytes stay if kind 0 goes and each run of kind 2 becomes one."""
    keep = kind > 0
    places = np.flatnonzero(keep)
    space = kind[places] == 2
    keep[places[1:][space[1:] & space[:-1]]] = False
    return keep


class Fuzzy:
    """Near matches of names: windows of as many words as a variant has, or one more.

    Lengths and trigrams of all windows of a text are compared with a variant by running
    sums over the text's bytes; only windows that pass are normalised and measured.
    """

    def __init__(self, names: list[str], threshold: float = 0.80):
        self.threshold = float32(threshold)
        self.variants: list[tuple[str, int, np.ndarray, int]] = []
        for i, name in enumerate(names):
            parts = name.split(" ")
            forms = [normal(name)] + ([v for v in (normal(parts[0]), normal(parts[-1])) if len(v) >= 3] if len(parts) > 1 else [])
            for form in forms:
                if count := len(_FUZZY.findall(form)):
                    bits = trigrams(form)
                    self.variants.append((form, i, np.array([bits >> b & 1 for b in range(128)], np.int32), count))
        self.most_words = max((v[3] for v in self.variants), default=0)

    def _score(self, form: str, window: str) -> float | None:
        plain = normal(window)
        longest = max(len(form), len(plain))
        if not longest or len(plain) > 128 or len(form) > 64 or min(len(form), len(plain)) / longest < self.threshold:
            return None
        most = math.floor(longest * (1.0 - self.threshold))
        if form == plain:
            return 1.0
        distance = edits(form, plain)
        score = 1.0 - distance / longest
        return score if distance <= most and score >= self.threshold else None

    def find(self, text: str, gaps: list[tuple[int, int]] | None = None) -> list[Span]:
        """Near matches in a byte text, or within gaps of it; leftmost, then longest."""
        if gaps is None:
            return self.find_many([text])[0]
        parts = self.find_many([text[a:b] for a, b in gaps])
        return greedy(Span(a + s.start, a + s.end, s.index, s.confidence) for (a, _), spans in zip(gaps, parts, strict=True) for s in spans)

    def find_many(self, texts: list[str]) -> list[list[Span]]:
        """Near matches of many texts, worked on together in runs of about a megabyte."""
        out: list[list[Span]] = []
        first, size = 0, 0
        for i, text in enumerate(texts):
            if size and size + len(text) > RUN:
                out += self._scan(texts[first:i])
                first, size = i, 0
            size += len(text)
        return out + self._scan(texts[first:])

    def _scan(self, texts: list[str]) -> list[list[Span]]:
        found: list[list[Span]] = [[] for _ in texts]
        text = "\n".join(texts)
        words = np.array([m.span() for m in _FUZZY.finditer(text)], np.int64).reshape(-1, 2)
        if not len(words) or not self.variants:
            return found
        ends = np.cumsum([len(t) + 1 for t in texts])
        owners = np.searchsorted(ends, words[:, 0], side="right")
        data = np.frombuffer(text.encode("latin-1"), np.uint8)
        keep = _kept(_KIND[data])
        clean = _LOWER[data[keep]]
        hashed = (31 * clean[:-2] + 7 * clean[1:-1] + clean[2:]) & 127 if len(clean) > 2 else np.zeros(0, np.int64)
        at_clean = np.concatenate([[0], np.cumsum(keep)])
        at_plain = np.concatenate([[0], np.cumsum(_kept(_PLAIN[data]))])
        folded = np.where(_PLAIN[data] == 2, 32, _LOWER[data])
        tally: dict[int, np.ndarray] = {}
        counts: dict[int, np.ndarray] = {}

        def letters(c: int) -> np.ndarray:
            if c not in counts:
                counts[c] = np.concatenate([[0], np.cumsum(folded == c)])
            return counts[c]

        for k, (form, owner, bits, count) in enumerate(self.variants):
            for size in (count, count + 1):
                if size > len(words):
                    continue
                start, stop = words[: len(words) - size + 1, 0], words[size - 1 :, 1]
                raw, plain = stop - start, at_plain[stop] - at_plain[start]
                ok = np.minimum(raw, len(form)) >= self.threshold * 0.7 * np.maximum(raw, len(form)) - 1e-9
                # a normal form may lose a blank at either end of what is counted here
                ok &= owners[: len(start)] == owners[size - 1 :]
                ok &= np.minimum(plain + 2, len(form)) >= self.threshold * np.maximum(plain - 2, len(form)) - 1e-9
                rows = np.flatnonzero(ok)
                if not len(rows):
                    continue
                if k not in tally:
                    tally[k] = np.concatenate([[0], np.cumsum(bits[hashed])])
                low, high = at_clean[start[rows]], at_clean[stop[rows]]
                runs = np.minimum(high, low + 64) - low
                last = np.minimum(low + np.maximum(runs - 2, 0), len(hashed))
                share = (tally[k][last] > tally[k][np.minimum(low, len(hashed))]) | (runs < 3) | (raw[rows] < 3)
                rows = rows[share]
                # what stays in place under the edits allowed: letters that both have
                both = sum(np.minimum(letters(c)[stop[rows]] - letters(c)[start[rows]], n) for c, n in Counter(form.encode("latin-1")).items())
                rows = rows[both >= self.threshold * np.maximum(plain[rows] - 2, len(form)) - 1e-9]
                for i in rows:
                    a, b = int(start[i]), int(stop[i])
                    if (score := self._score(form, text[a:b])) is not None:
                        which = owners[i]
                        begin = int(ends[which]) - len(texts[which]) - 1
                        found[which].append(Span(a - begin, b - begin, owner, score))
        return [greedy(f) for f in found]


def gaps(length: int, masked: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """What masked regions leave."""
    out, at = [], 0
    for start, end in sorted(masked):
        if start > at:
            out.append((at, start))
        at = max(at, end)
    return out + [(at, length)] * (at < length)
