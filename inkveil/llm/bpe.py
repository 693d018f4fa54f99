"""Byte-level BPE encoding and decoding on padded numpy matrices.

A text is split by the tokenizer's pattern.  Distinct pieces are put in buckets by length,
one padded row of byte ids each; in every round each row merges its leftmost pair of
minimum rank, all rows at once: pair ranks come from a hash table probed by vector
operations, the row closes up over the merged place, and finished rows leave the matrix.
Very long pieces get a row of their own, in which a round merges all places of the minimum
rank that the one-by-one order would merge next to each other.

Null and empty texts give no ids; repeated rows give equal rows; texts are encoded whole;
other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable

import numpy as np
import regex
from pyspark.sql import DataFrame

from .common import map_rows

NONE = np.int32(0x7FFFFFFF)
#: Lengths up to which pieces share a padded matrix, and the most pieces a cache holds.
BUCKETS = (2, 3, 4, 5, 6, 7, 8, 10, 12, 14, 16, 20, 24, 32, 48, 64, 96, 128, 256)
CACHE, ROWS = 300_000, 1 << 15
#: White space as the tokenizer's own regular expressions know it.
SPACE = r"\t-\r\x20\x85\xa0  -     　"


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Ranks by token from the text of a rank file."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in data.splitlines() if line.strip())}


class Pairs:
    """Rank of the merged token by (left id, right id): open addressing in numpy arrays."""

    def __init__(self, ranks: dict[bytes, int]):
        keys, values = [], []
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                left, right = ranks.get(token[:i]), ranks.get(token[i:])
                if left is not None and right is not None:
                    keys.append(left << 32 | right)
                    values.append(rank)
        key, value = np.array(keys, np.uint64), np.array(values, np.int32)
        self.bits = max(4, int(len(key) * 6).bit_length())
        size = 1 << self.bits
        self.keys, self.values = np.full(size, np.uint64(0xFFFFFFFFFFFFFFFF)), np.full(size, NONE, np.int32)
        at, left = self._slot(key), np.arange(len(key))
        while len(left):  # each free slot takes one of the keys that want it; the rest move on
            free = self.values[at[left]] == NONE
            wanted, first = np.unique(at[left[free]], return_index=True)
            placed = left[free][first]
            self.keys[wanted], self.values[wanted] = key[placed], value[placed]
            left = np.setdiff1d(left, placed, assume_unique=True)
            at[left] = (at[left] + 1) & (size - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of the pairs; NONE where they don't merge or an id is negative."""
        key = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        at = self._slot(key)
        there = self.keys[at]
        out = np.where(there == key, self.values[at], NONE)
        more = np.flatnonzero((there != key) & (self.values[at] != NONE))
        while len(more):
            at[more] = (at[more] + 1) & ((1 << self.bits) - 1)
            there, value = self.keys[at[more]], self.values[at[more]]
            hit = there == key[more]
            out[more[hit]] = value[hit]
            more = more[~hit & (value != NONE)]
        out[(left < 0) | (right < 0)] = NONE
        return out


class Encoder:
    """Encodes and decodes whole texts in batches; holds a bounded cache of pieces."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.pairs = Pairs(ranks)
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.pieces_of = regex.compile(pattern.replace(r"[^\s", f"[^{SPACE}").replace(r"\s", f"[{SPACE}]").replace(r"\S", f"[^{SPACE}]")).findall
        tokens = sorted(ranks.items(), key=lambda x: x[1])
        size = tokens[-1][1] + 1
        self.token_len = np.zeros(size, np.int64)
        self.token_len[[r for _, r in tokens]] = [len(t) for t, _ in tokens]
        self.token_at = np.concatenate([[0], np.cumsum(self.token_len)[:-1]])
        self.token_bytes = np.frombuffer(b"".join(t for t, _ in tokens), np.uint8)
        self._clear()

    def _clear(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.used = np.empty(1 << 16, np.int32), 0
        self.at, self.size = np.empty(1 << 14, np.int64), np.empty(1 << 14, np.int32)

    def _learn(self, pieces: list[str]) -> None:
        """Encode pieces that the cache doesn't know."""
        raw = [p.encode() for p in pieces]
        length = np.array([len(r) for r in raw])
        first = len(self.known)
        need = first + len(pieces)
        if need > len(self.at):
            self.at, self.size = np.resize(self.at, 2 * need), np.resize(self.size, 2 * need)
        self.known.update(zip(pieces, range(first, need), strict=True))
        low = 0
        for high in (*BUCKETS, None):
            rows = np.flatnonzero((length > low) & (length <= high)) if high else np.flatnonzero(length > low)
            if not high:
                for r in rows:
                    self._store(np.array([first + r]), *self._long(self.byte_ids[np.frombuffer(raw[r], np.uint8)]))
                break
            for k in range(0, len(rows), ROWS):
                part = rows[k : k + ROWS]
                data = np.frombuffer(b"".join(raw[r].ljust(high, b"\0") for r in part), np.uint8).reshape(len(part), high)
                ids = self.byte_ids[data]
                ids[np.arange(high) >= length[part, None]] = -1
                self._store(first + part, *self._merge(ids))
            low = high

    def _store(self, which: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        if self.used + len(ids) > len(self.flat):
            self.flat = np.resize(self.flat, 2 * (self.used + len(ids)))
        self.flat[self.used : self.used + len(ids)] = ids
        self.at[which] = self.used + np.cumsum(sizes) - sizes
        self.size[which] = sizes
        self.used += len(ids)

    def _merge(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their number for every row of a padded matrix (-1: none)."""
        done, rows = ids.copy(), np.arange(len(ids))
        ranks = self.pairs(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(ids), -1)
        while len(rows):
            place = ranks.argmin(1)
            best = ranks[np.arange(len(rows)), place]
            over = best == NONE
            if over.any():
                done[rows[over], : ids.shape[1]] = ids[over]
                done[rows[over], ids.shape[1] :] = -1
                go = ~over
                ids, ranks, rows, place, best = ids[go], ranks[go], rows[go], place[go], best[go]
                if not len(rows):
                    break
            n, width = ids.shape
            line = np.arange(n)
            ids[line, place] = best
            cols = np.arange(width - 1)
            ids = np.take_along_axis(ids, cols + (cols > place[:, None]), 1)  # closes up over place + 1
            if width == 2:
                done[rows, :1], done[rows, 1:] = ids, -1
                break
            cols = cols[:-1]
            ranks = np.take_along_axis(ranks, cols + (cols >= place[:, None]), 1)
            has = np.flatnonzero(place > 0)
            ranks[has, place[has] - 1] = self.pairs(ids[has, place[has] - 1], ids[has, place[has]])
            has = np.flatnonzero(place < width - 2)
            ranks[has, place[has]] = self.pairs(ids[has, place[has]], ids[has, place[has] + 1])
        keep = done >= 0
        return done[keep], keep.sum(1)

    def _long(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for one long row."""
        ranks = self.pairs(ids[:-1], ids[1:])
        while len(ranks) and (best := ranks.min()) != NONE:
            place = np.flatnonzero(ranks == best)
            if len(place) > 1:  # of a run of overlapping places every other one merges
                starts = np.concatenate([[True], np.diff(place) > 1])
                run = np.maximum.accumulate(np.where(starts, np.arange(len(place)), 0))
                place = place[(np.arange(len(place)) - run) % 2 == 0]
            new = ids.copy()
            new[place] = best
            left, right = place > 0, place + 2 < len(ids)
            # a new pair of no higher rank would have to go first: then stop after its place
            soon = np.zeros(len(place), bool)
            soon[left] |= self.pairs(ids[place[left] - 1], new[place[left]]) <= best
            soon[right] |= self.pairs(new[place[right]], ids[place[right] + 2]) <= best
            if soon.any():
                place = place[: soon.argmax() + 1]
            ids[place] = best
            ids = np.delete(ids, place + 1)
            ranks = self.pairs(ids[:-1], ids[1:])
        return ids, np.array([len(ids)])

    def encode(self, texts: Iterable[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts one after another, and the number of each text's."""
        split = [self.pieces_of(text) if text else [] for text in texts]
        fresh = list({p for pieces in split for p in pieces} - self.known.keys())
        if len(self.known) + len(fresh) > CACHE:
            self._clear()
            fresh = list({p for pieces in split for p in pieces})
        if fresh:
            self._learn(fresh)
        known = self.known
        which = np.fromiter((known[p] for pieces in split for p in pieces), np.int64)
        size = self.size[which].astype(np.int64)
        ids = self.flat[_spread(self.at[which], size)]
        ends = np.concatenate([[0], np.cumsum(size)])
        bounds = ends[np.concatenate([[0], np.cumsum([len(p) for p in split])]).astype(np.int64)]
        return ids, np.diff(bounds)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """The bytes of each text, from all ids one after another."""
        size = self.token_len[ids]
        data = self.token_bytes[_spread(self.token_at[ids], size)].tobytes()
        ends = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(counts)])]
        return [data[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... of every run, one run after another."""
    before = np.cumsum(sizes) - sizes
    return np.repeat(starts - before, sizes) + np.arange(int(sizes.sum()))


def encode(docs: DataFrame, rank_file: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, the ids.

    The rank file (about 1 MB) is read on the driver and broadcast.
    """
    with open(rank_file, "rb") as file:
        ranks = docs.sparkSession.sparkContext.broadcast(file.read())

    def step():
        encoder = Encoder(read_ranks(ranks.value), pattern)

        def work(rows):
            out = {name: [] for name in ("n_tokens", "ids_sha256", "decoded_sha256", "ids")}
            for k in range(0, len(rows["text"]), 200):
                ids, counts = encoder.encode(rows["text"][k : k + 200])
                plain = encoder.decode(ids, counts)
                for part, back in zip(np.split(ids, np.cumsum(counts)[:-1]), plain, strict=True):
                    out["n_tokens"].append(len(part))
                    out["ids_sha256"].append(hashlib.sha256(part.astype("<u4").tobytes()).hexdigest())
                    out["decoded_sha256"].append(hashlib.sha256(back).hexdigest())
                    out["ids"].append(part if with_ids else None)
            return out | {"doc_id": rows["doc_id"]}

        return work

    return map_rows(docs, ["doc_id", "text"], "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids, step)
