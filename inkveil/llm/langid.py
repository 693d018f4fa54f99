"""Language identification by a bidirectional gated recurrent network over bytes.

Two gated recurrent units read a window of bytes, one from each side; every position gets
a probability for each language from both states, and a document's probabilities are the
mean over all positions of all its windows, which together cover the whole text.  Gates
and candidates use x / (1 + |x|), so that a step is a handful of vector operations over
many windows at once.  Weights are trained in numpy by backpropagation through time.

The training sample is bounded: at most ``DOCS`` labelled documents, an equal share of
each language, ``CROPS`` windows of each.  Only text and label are used; of doc_id only
the hash that picks the sample and the held-out quarter.

Null texts and texts without a letter are ``und`` with score 0; repeated rows are labelled
alike; without any labelled document all texts are ``und``; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_rows

#: Labelled documents that training may use, windows of each, bytes of a training window.
DOCS, CROPS, CROP = 2400, 3, 96
#: States of each direction; bytes and number of the windows that are labelled together.
HIDDEN, WINDOW, LANES = 8, 128, 1024
EPOCHS, BATCH, STEP = 10, 192, 0.02
#: A document is rejected if its language has less than this share.
ACCEPT = 0.3
#: Values of lang that can be learned; more of them are an error.
LANGUAGES = 1000
PAD = 256
_FOLD = np.arange(257, dtype=np.int32)
_FOLD[65:91] += 32
_LETTER = regex.compile(r"\p{L}")


def has_letter(text: str) -> bool:
    return _LETTER.search(text) is not None


def _soft(a: np.ndarray) -> np.ndarray:
    return a / (1 + np.abs(a))


class Network:
    """Weights: for each direction a table of byte inputs (3H, 257) for update, reset and
    candidate, and recurrent matrices; and the output layer (languages, 2H)."""

    def __init__(self, languages: list[str], seed: int = 5):
        rng = np.random.default_rng(seed)
        h, n = HIDDEN, len(languages)
        self.languages = languages
        self.p = {}
        for side in "fb":
            self.p[f"x{side}"] = rng.normal(0, 0.5, (3 * h, 257)).astype(np.float32)
            self.p[f"u{side}"] = rng.normal(0, 0.4, (2 * h, h)).astype(np.float32)
            self.p[f"c{side}"] = rng.normal(0, 0.4, (h, h)).astype(np.float32)
        self.p["v"] = rng.normal(0, 0.3, (n, 2 * h)).astype(np.float32)
        self.p["b"] = np.zeros((n, 1), np.float32)
        self.seal()

    def seal(self) -> None:
        """Padding never updates a state: its update gate is closed."""
        for side in "fb":
            self.p[f"x{side}"][:HIDDEN, PAD] = -1e6
            self.p[f"x{side}"][HIDDEN:, PAD] = 0

    def _scan(self, side: str, x: np.ndarray, keep: bool = False):
        """States (T, H, B) of one direction over windows x (T, B); keep: all that BPTT needs."""
        table, u, c = self.p[f"x{side}"], self.p[f"u{side}"], self.p[f"c{side}"]
        steps, lanes = x.shape
        h2 = 2 * HIDDEN
        state = np.zeros((HIDDEN, lanes), np.float32)
        out = np.empty((steps, HIDDEN, lanes), np.float32)
        kept = [] if keep else None
        pre, gates, size = np.empty((3 * HIDDEN, lanes), np.float32), np.empty((h2, lanes), np.float32), np.empty((h2, lanes), np.float32)
        for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
            np.take(table, x[t], axis=1, out=pre, mode="clip")
            np.matmul(u, state, out=gates)
            gates += pre[:h2]
            if keep:
                slope = 0.5 / np.square(1 + np.abs(gates))
            np.abs(gates, out=size)
            size += 1
            gates /= size
            gates *= 0.5
            gates += 0.5
            z, r = gates[:HIDDEN], gates[HIDDEN:]
            mixed = r * state
            cand = c @ mixed
            cand += pre[h2:]
            if keep:
                bend = 1 / np.square(1 + np.abs(cand))
            half = size[:HIDDEN]
            np.abs(cand, out=half)
            half += 1
            cand /= half
            if keep:
                kept.append((t, z.copy(), r.copy(), cand.copy(), mixed, state.copy(), slope, bend))
            cand -= state
            cand *= z
            state += cand
            out[t] = state
        return out, kept

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """(T, languages, B): a distribution at every position of windows x (T, B)."""
        states = np.concatenate([self._scan("f", x)[0], self._scan("b", x)[0]], axis=1)
        logit = np.matmul(self.p["v"], states)
        logit += self.p["b"]
        logit -= logit.max(1, keepdims=True)
        np.exp(logit, out=logit)
        logit /= logit.sum(1, keepdims=True)
        return logit

    def gradients(self, x: np.ndarray, label: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy over all positions of windows x (T, B), and its gradients."""
        sides = {side: self._scan(side, x, keep=True) for side in "fb"}
        states = np.concatenate([sides["f"][0], sides["b"][0]], axis=1)
        logit = np.matmul(self.p["v"], states) + self.p["b"]
        logit -= logit.max(1, keepdims=True)
        prob = np.exp(logit)
        prob /= prob.sum(1, keepdims=True)
        mask = (x != PAD).astype(np.float32)
        total = max(float(mask.sum()), 1.0)
        lanes = np.arange(x.shape[1])
        loss = -float((np.log(prob[:, label, lanes] + 1e-9) * mask).sum()) / total
        delta = prob
        delta[:, label, lanes] -= 1
        delta *= (mask / total)[:, None]
        grads = {"v": np.tensordot(delta, states, ([0, 2], [0, 2])), "b": delta.sum((0, 2))[:, None]}
        into = np.matmul(self.p["v"].T, delta)
        for k, side in enumerate("fb"):
            u, c = self.p[f"u{side}"], self.p[f"c{side}"]
            du, dc = np.zeros_like(u), np.zeros_like(c)
            inputs = np.empty((x.shape[0], 3 * HIDDEN, x.shape[1]), np.float32)
            back = np.zeros((HIDDEN, x.shape[1]), np.float32)
            for t, z, r, cand, mixed, before, slope, bend in reversed(sides[side][1]):
                back = back + into[t, k * HIDDEN : (k + 1) * HIDDEN]
                d_cand = back * z * bend
                d_mixed = c.T @ d_cand
                d_gate = np.concatenate([back * (cand - before), d_mixed * before]) * slope
                dc += d_cand @ mixed.T
                du += d_gate @ before.T
                inputs[t, : 2 * HIDDEN], inputs[t, 2 * HIDDEN :] = d_gate, d_cand
                back = back * (1 - z) + d_mixed * r + u.T @ d_gate
            flat = x.ravel()
            grads[f"x{side}"] = np.stack([np.bincount(flat, weights=inputs[:, j].ravel(), minlength=257) for j in range(3 * HIDDEN)])
            grads[f"u{side}"], grads[f"c{side}"] = du, dc
        return loss, grads

    def fit(self, x: np.ndarray, label: np.ndarray, epochs: int = EPOCHS, seed: int = 7) -> list[float]:
        """Train on windows x (T, N) with Adam; returns the loss of each epoch."""
        rng = np.random.default_rng(seed)
        first, second, turn, losses = {k: 0.0 for k in self.p}, {k: 0.0 for k in self.p}, 0, []
        batches = max(1, -(-x.shape[1] // BATCH))
        for epoch in range(epochs):
            sums = 0.0
            for rows in np.array_split(rng.permutation(x.shape[1]), batches):
                loss, grads = self.gradients(x[:, rows], label[rows])
                sums += loss / batches
                turn += 1
                norm = np.sqrt(sum(float(np.square(g).sum()) for g in grads.values()))
                rate = STEP * (0.5 * (1 + np.cos(np.pi * turn / (epochs * batches + 1)))) * np.sqrt(1 - 0.999**turn) / (1 - 0.9**turn)
                for k, g in grads.items():
                    g = g * min(1.0, 1.0 / (norm + 1e-9))
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.999 * second[k] + 0.001 * g * g
                    self.p[k] -= (rate * first[k] / (np.sqrt(second[k]) + 1e-8)).astype(np.float32)
                self.seal()
            losses.append(sums)
        return losses

    def label(self, text: str) -> np.ndarray:
        """The language (index) of every byte of a text."""
        data = text.encode()
        x = windows([data])[0]
        return self.probabilities(x).argmax(1).T.ravel()[: len(data)]

    def pool(self, texts: list[str]) -> np.ndarray:
        """(texts, languages): probabilities pooled over all positions of each whole text."""
        sums = np.zeros((len(texts), len(self.languages)))
        x, owner, sizes = windows([t.encode() for t in texts])
        for k in range(0, x.shape[1], LANES):
            part = np.ascontiguousarray(x[:, k : k + LANES])
            prob = self.probabilities(part)
            partial = np.flatnonzero((part == PAD).any(0))
            prob[:, :, partial] *= (part[:, None, partial] != PAD)
            by_window = prob.sum(0)
            own = owner[k : k + LANES]
            for j in range(len(self.languages)):
                sums[:, j] += np.bincount(own, weights=by_window[j], minlength=len(texts))
        return sums / np.maximum(sizes, 1)[:, None]


def windows(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows (WINDOW, N) that cover the byte strings, the string of each, and the strings' lengths."""
    sizes = np.array([len(r) for r in raw])
    count = -(-sizes // WINDOW)
    owner = np.repeat(np.arange(len(raw)), count)
    data = b"".join(r.ljust(int(c) * WINDOW, b"\0") for r, c in zip(raw, count, strict=True))
    x = _FOLD[np.frombuffer(data, np.uint8)].reshape(-1, WINDOW)
    last = np.cumsum(count)[count > 0] - 1
    tail = (sizes - (count - 1) * WINDOW)[count > 0]
    rest = x[last]
    rest[np.arange(WINDOW) >= tail[:, None]] = PAD
    x[last] = rest
    return np.ascontiguousarray(x.T), owner, sizes


def held_out() -> Column:
    """Documents that are never learned from; false where doc_id is null."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, docs_most: int = DOCS, seed: int = 5) -> Network | None:
    """Train a network on a bounded sample of the labelled documents; None without any.

    Languages are first counted; a document is drawn if its hash lies under its language's
    share, so what reaches the driver has the size of the sample, not of the corpus.
    """
    labelled = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    counts = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES + 1).collect()
    if len(counts) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} values of lang: some languages would never be learned")
    if not counts:
        return None
    languages = sorted(r["lang"] for r in counts)
    quota = max(1, docs_most // len(languages))
    size = F.create_map(*[x for r in counts for x in (F.lit(r["lang"]), F.lit(float(r["n"])))])[F.col("lang")]
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", "lang"), 11) / F.lit(float(1 << 53)) * size
    chosen = labelled.withColumn("draw", draw).where(F.col("draw") < 1.3 * quota + 20)
    crops = [F.substring(F.col("text"), (F.pmod(F.xxhash64(F.lit(j), "doc_id"), F.greatest(F.length("text") - CROP, F.lit(1))) + 1).cast("int"), F.lit(CROP)) for j in range(CROPS)]
    rows = chosen.select("lang", F.array(*crops).alias("crops"), "draw", "doc_id").orderBy("draw", "doc_id").limit(docs_most).collect()
    texts, label = [], []
    for r in rows:
        for crop in dict.fromkeys(r["crops"]):
            if has_letter(crop):
                texts.append(crop.encode()[:CROP])
                label.append(languages.index(r["lang"]))
    if not texts:
        return None
    data = np.frombuffer(b"".join(t.ljust(CROP, b"\0") for t in texts), np.uint8).reshape(-1, CROP)
    x = np.where(np.arange(CROP) < np.array([len(t) for t in texts])[:, None], _FOLD[data], PAD).T.astype(np.int32)
    network = Network(languages, seed)
    network.fit(np.ascontiguousarray(x), np.array(label))
    return network


def labels(network: Network | None, texts: list[str | None]) -> tuple[list[str], list[float]]:
    """The language and score of each whole text."""
    which = [i for i, t in enumerate(texts) if t and network and has_letter(t)]
    lang, score = ["und"] * len(texts), [0.0] * len(texts)
    first = 0
    while first < len(which):  # some LANES windows at a time
        last, size = first, 0
        while last < len(which) and (last == first or size < LANES * WINDOW):
            size += len(texts[which[last]])
            last += 1
        group = which[first:last]
        pooled = network.pool([texts[i] for i in group])
        for i, row in zip(group, pooled, strict=True):
            lang[i], score[i] = network.languages[int(row.argmax())], float(min(row.max(), 1.0))
        first = last
    return lang, score


def predict(docs: DataFrame, network: Network | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score of each document."""

    def step():
        def work(rows):
            lang, score = labels(network, rows["text"])
            return {"doc_id": rows["doc_id"], "held_out": rows["held_out"], "lang_pred": lang, "score": score}

        return work

    return map_rows(docs.select("doc_id", "text", held_out().alias("held_out")), ["doc_id", "held_out", "text"], "doc_id long, held_out boolean, lang_pred string, score double", step)


def accept(docs: DataFrame, network: Network | None, least: float = ACCEPT) -> DataFrame:
    """The documents whose language is told with a score of at least ``least``.

    A null lang becomes the predicted one; other values stay.
    """
    names = ["doc_id", "text", "lang", "source", "n_chars"]

    def step():
        def work(rows):
            lang, score = labels(network, rows["text"])
            keep = [i for i, (name, s) in enumerate(zip(lang, score, strict=True)) if name != "und" and s >= least]
            out = {name: [rows[name][i] for i in keep] for name in names}
            out["lang"] = [old if old is not None else lang[i] for old, i in zip(out["lang"], keep, strict=True)]
            return out

        return work

    return map_rows(docs, names, "doc_id long, text string, lang string, source string, n_chars long", step)
