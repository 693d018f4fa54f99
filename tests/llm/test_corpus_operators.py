import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from inkveil.llm import common, dartminhash, flac, kdshard, mix

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


# ---------------------------------------------------------------- op4


def brute_targets(sizes, weights=(5, 2, 1), most=3):
    """Shares by weight; what is above a cap is shared again among the others."""
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    capped, total = set(), sum(sizes.values())
    while True:
        left = total - sum(most * sizes[s] for s in capped)
        free = sum(w[s] for s in order if s not in capped)
        target = {s: most * sizes[s] if s in capped else left * w[s] / free for s in order}
        over = {s for s in order if s not in capped and target[s] > most * sizes[s]}
        if not over:
            return target
        capped |= over


def make_docs(rng, sources):
    rows = []
    for source, n in sources.items():
        rows += [(len(rows) + i, "w " * rng.randint(1, 60), "en", source, 1) for i in range(n)]
    return rows


@pytest.mark.parametrize("sources", [{"a": 400, "b": 300, None: 200}, {"a": 20, "b": 900, "c": 30, "d": 5}, {"x": 50}, {"a": 1, "b": 3000}])
def test_mix(spark, sources):
    rows = make_docs(random.Random(4), sources)
    got = mix.mix(spark.createDataFrame(rows, DOCS)).collect()
    size = Counter()
    for r in rows:
        size[r[3]] += len(r[1].split())
    want = brute_targets(size)
    source = {r[0]: r[3] for r in rows}
    taken = Counter()
    for r in got:
        assert r.target == pytest.approx(want[source[r.doc_id]]) and r.source_size == size[source[r.doc_id]]
        assert r.taken % r.size == 0 and r.taken <= 3 * r.size
        taken[source[r.doc_id]] += r.taken
    for s in size:
        assert abs(taken[s] - want[s]) <= 60
    again = mix.mix(spark.createDataFrame(list(reversed(rows)), DOCS).repartition(3)).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, got))


def test_mix_by_key(spark, monkeypatch):
    rows = make_docs(random.Random(4), {"a": 200, "b": 300, None: 100})
    plain = sorted(map(tuple, mix.mix(spark.createDataFrame(rows, DOCS)).collect()))
    monkeypatch.setattr(mix, "BROADCAST_SOURCES", 0)
    assert sorted(map(tuple, mix.mix(spark.createDataFrame(rows, DOCS)).collect())) == plain


def test_taken_rows_match_plan(spark):
    docs = spark.createDataFrame(make_docs(random.Random(6), {"a": 50, "b": 200}), DOCS)
    copies = {r.doc_id: r.copies for r in mix.mix(docs).collect() if r.copies}
    assert Counter(r.doc_id for r in mix.take(docs).collect()) == copies


# ---------------------------------------------------------------- op8


def shingle_set(text):
    words = "".join(c if c.isascii() and c.isalnum() or ord(c) > 127 else " " for c in text.lower()).split()
    return frozenset([tuple(words)] if 0 < len(words) < 5 else zip(words, words[1:], words[2:], words[3:], words[4:]))


def brute_classes(rows):
    sets = {i: shingle_set(t) for i, t in rows if t is not None}
    texts = dict(rows)
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            a, b = sets[i], sets[j]
            if texts[i] == texts[j] or (a and b and len(a & b) >= 0.8 * len(a | b)):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets} | {i: i for i, t in rows if t is None}


def test_recall_on_the_corpus(spark):
    """Rows whose id is divisible by 50 against all rows: every pair at 0.8 or more is in one class."""
    docs = common.read(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text")
    sets = {r.doc_id: shingle_set(r.text) for r in docs.collect() if r.text}
    found = {r.doc_id: r.class_id for r in dartminhash.dedup(docs).collect()}
    pairs = [(i, j) for i in sets if i % 50 == 0 for j in sets if i != j and sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    assert pairs and sum(found[i] == found[j] for i, j in pairs) == len(pairs)


def near_copies(rng, groups):
    rows = []
    for g in range(groups):
        base = [f"w{rng.randint(0, 3000)}" for _ in range(rng.randint(3, 150))]
        for _ in range(rng.choice([1, 1, 2, 12])):
            words = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4, 8])):
                words[rng.randrange(len(words))] = f"e{rng.randint(0, 10**6)}"
            rows.append((len(rows), " ".join(words)))
    return rows + [(len(rows), None), (len(rows) + 1, ""), (len(rows) + 2, ""), (len(rows) + 3, "!!!"), (len(rows) + 4, "???")]


def test_classes_against_brute_force(spark):
    rows = near_copies(random.Random(9), 60)
    got = {r.doc_id: r.class_id for r in dartminhash.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_classes(rows)


def test_large_group_with_several_classes(spark):
    rng = random.Random(12)
    base = [f"w{i}" for i in range(100)]
    rows = []
    for i in range(160):  # copies of copies: some links only between edited ones
        words = list(base) if i < 40 or rng.random() < 0.5 else rows[rng.randrange(40, i)][1].split()
        for _ in range(rng.choice([0, 1, 3, 5])):
            words[rng.randrange(100)] = f"e{rng.randint(0, 10**6)}"
        rows.append((i, " ".join(words)))
    got = {r.doc_id: r.class_id for r in dartminhash.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_classes(rows)


def repeated_rows(groups, copies):
    """Buckets of several classes: many texts near B and C but not alike; B and C are, and repeat."""
    rows = []
    for g in range(groups):
        base = [f"g{g}w{i}" for i in range(104)]
        texts = [base[:94] + [f"g{g}a{n}x{i}" for i in range(24)] for n in range(60)] + [base, base[:94] + [f"g{g}c{i}" for i in range(10)]]
        for n, words in enumerate(texts):
            rows += [(len(rows), " ".join(words))] * (copies if n >= 60 else 1)
    return rows


@pytest.mark.parametrize("copies", [2, 3])
def test_repeated_rows_in_a_bucket_of_several_classes(spark, copies):
    rows = repeated_rows(6, copies)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in dartminhash.dedup(docs).collect()} == brute_classes(rows)
    want = len(set(brute_classes(list(dict(rows).items())).values()))
    assert dartminhash.keep_one(docs.withColumn("doc_id", F.when(F.col("doc_id") % 2 == 0, F.col("doc_id")))).count() == want


def test_joins_instead_of_broadcasts(spark, monkeypatch):
    rows = near_copies(random.Random(3), 15)
    monkeypatch.setattr(dartminhash, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(dartminhash, "EDGES", -1)
    got = {r.doc_id: r.class_id for r in dartminhash.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_classes(rows)


def test_keep_one(spark):
    rows = [(i, t, "en", "s", 1) for i, t in near_copies(random.Random(2), 25)]
    rows += rows[:3]  # repeated rows
    docs = spark.createDataFrame(rows, DOCS)
    kept = [r.doc_id for r in dartminhash.keep_one(docs).collect()]
    classes = brute_classes([(r[0], r[1]) for r in rows])
    assert sorted(kept) == sorted(set(classes.values()))


def test_components_both_ways(spark):
    rng = random.Random(1)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(200)] + [(i, i + 1) for i in range(500, 560)]
    df = spark.createDataFrame(edges, "a long, b long")
    assert sorted(map(tuple, dartminhash.components(df).collect())) == sorted(map(tuple, dartminhash.components(df, 0).collect()))


@pytest.mark.parametrize("n", [3, 20, 300, 4000])
def test_signature_estimates_jaccard(n):
    rng = np.random.default_rng(n)
    found, true = [], []
    for _ in range(40):
        shared = round(2 * n * 0.8 / 1.8)
        a = rng.integers(0, 2**63, n).astype(np.uint64)
        b = np.concatenate([a[:shared], rng.integers(0, 2**63, n - shared).astype(np.uint64)])
        s = dartminhash.dart_signature(np.concatenate([a, b]), None, np.repeat([0, 1], n), 2)
        found.append((s[0] == s[1]).mean())
        true.append(shared / (2 * n - shared))
    assert np.mean(found) == pytest.approx(np.mean(true), abs=0.03)


def test_sketches_of_similar_sets_pass():
    """Sketches of pairs at 0.8 differ in 18 of 96 coordinates on average, far under the bound."""
    rng = np.random.default_rng(5)
    apart = []
    for _ in range(200):
        a = rng.integers(0, 2**63, 180).astype(np.uint64)
        b = np.concatenate([a[:160], rng.integers(0, 2**63, 20).astype(np.uint64)])
        x, y = dartminhash.sketch(dartminhash.dart_signature(np.concatenate([a, b]), None, np.repeat([0, 1], 180), 2))
        apart.append(sum(int(p) >> (4 * i) & 15 != int(q) >> (4 * i) & 15 for p, q in zip(x, y) for i in range(16)))
    assert np.mean(apart) == pytest.approx(18, abs=1.5) and max(apart) <= dartminhash.SKETCH_APART


def test_signature_estimates_weighted_jaccard():
    rng = np.random.default_rng(0)
    e = rng.integers(0, 2**63, 50).astype(np.uint64)
    w = rng.random(50) * 5
    v = w * rng.random(50) * 1.2
    s = dartminhash.dart_signature(np.concatenate([e, e]), np.concatenate([w, v]), np.repeat([0, 1], 50), 2, k=2000)
    assert (s[0] == s[1]).mean() == pytest.approx(np.minimum(w, v).sum() / np.maximum(w, v).sum(), abs=0.04)


# ---------------------------------------------------------------- op9


@pytest.mark.parametrize("shards", [1, 5, 8])
def test_shards_balance(spark, shards):
    rng = random.Random(shards)
    rows = [(i, "x" * rng.randint(0, 300) + "é" * rng.randint(0, 9) + "\n" * rng.randint(0, 4)) for i in range(3000)] + [(i, "same text " * 20) for i in range(3000, 4200)]
    got = kdshard.shard(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), shards=shards).collect()
    text = dict(rows)
    load, slots = Counter(), defaultdict(list)
    for r in got:
        assert r.size == len(text[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(text[r.doc_id].encode())
        assert r.law == "bytes" and r.grown_shard is None
        load[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert set(load) == set(range(shards))
    assert max(load.values()) - min(load.values()) <= 0.02 * sum(load.values()) / shards
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_small_groups_stay_together(spark):
    rng = random.Random(1)
    rows = [(i, f"text {i // 3} " * (1 + i // 3 % 4)) for i in range(9000)]
    rng.shuffle(rows)
    text, where = dict(rows), defaultdict(set)
    for r in kdshard.shard(spark.createDataFrame(rows, "doc_id long, text string"), shards=8).collect():
        where[text[r.doc_id]].add(r.shard)
    assert all(len(s) == 1 for s in where.values())


def test_layout_changes_nothing(spark, tmp_path):
    """The same rows in another order, in other files and on other partitions get the same places."""
    rng = random.Random(8)
    rows = [(i, f"text {rng.randint(0, 900)} " * rng.randint(1, 30)) for i in range(2000)] + [(5000 + i, "same text " * 20) for i in range(2000)]
    rows += [(None, "same text " * 20)] * 300 + [(7, None)] * 40
    rng.shuffle(rows)
    schema = "doc_id long, text string"
    tables = [spark.createDataFrame(rows, schema).coalesce(1), spark.createDataFrame(rows[::-1], schema).repartition(7)]
    rng.shuffle(rows)
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    tables.append(common.read(spark, str(tmp_path), "documents"))
    first, *rest = [sorted(map(str, kdshard.shard(t, shards=8).collect())) for t in tables]
    assert len(first) == len(rows) and all(r == first for r in rest)


def test_target_bytes(spark):
    rows = [(i, "y" * 99) for i in range(1000)]
    got = Counter(r.shard for r in kdshard.shard(spark.createDataFrame(rows, "doc_id long, text string"), target_bytes=10_000).collect())
    assert len(got) == 10 and set(got.values()) == {100}


# ---------------------------------------------------------------- op10


def payloads():
    rng = np.random.default_rng(3)
    texts = ["hello " * n for n in (0, 1, 40, 3000)]
    return [flac.payload(t)[1] for t in texts] + [rng.bytes(576 * 3), bytes(range(256)) * 9, bytes(576 * 150), b"\x01\xfe" * 288 * 5, (np.cumsum(rng.integers(-2, 3, 576 * 4)) % 256).astype(np.uint8).tobytes()]


def test_flac_round_trip():
    raw = payloads()
    media = flac.encode(raw)
    for p, m, s in zip(raw, media, flac.decode(media), strict=True):
        assert s.ok and (s.samples[0] + 128).astype(np.uint8).tobytes() == p
        assert s.offsets == list(range(0, len(p), 576))
        for sample, offset, size in s.seek:  # a seek point leads to the frame that starts at its sample
            first = m.index(b"\xff\xf8\x24\x02")
            frame = flac._header(m, first + offset, 8)
            assert frame.number * 576 == sample and frame.size == size


def test_flac_damage():
    good = flac.encode(payloads()[3:4])[0]
    bad = bytearray(good)
    bad[-40] ^= 4
    assert [s.error for s in flac.decode([bytes(bad), good[:-30], None, b"fLaC", b"RIFF", good])] == ["frame checksum", "frame checksum", "no FLAC marker", "no STREAMINFO", "no FLAC marker", ""]


class Writer:
    """A plain bit writer for streams that the encoder doesn't make."""

    def __init__(self):
        self.bits = []

    def put(self, value, width):
        self.bits += [(value >> (width - 1 - i)) & 1 for i in range(width)]

    def rice(self, value, k):
        u = value * 2 if value >= 0 else -value * 2 - 1
        self.bits += [0] * (u >> k) + [1]
        self.put(u, k)

    def bytes(self):
        return np.packbits(self.bits).tobytes()


def crc(data, width, poly):
    value = 0
    for byte in data:
        value ^= byte << (width - 8)
        for _ in range(8):
            value = ((value << 1) ^ (poly if value >> (width - 1) & 1 else 0)) & ((1 << width) - 1)
    return value


def stream_of(frame_bits, head, bits, channels, total, md5):
    frame = head + bytes([crc(head, 8, 0x07)]) + frame_bits
    frame += crc(frame, 16, 0x8005).to_bytes(2, "big")
    info = (16).to_bytes(2, "big") * 2 + bytes(6) + (44100 << 44 | (channels - 1) << 41 | (bits - 1) << 36 | total).to_bytes(8, "big") + md5
    return b"fLaC\x80" + len(info).to_bytes(3, "big") + info + frame


def test_flac_lpc_stereo_escape_and_wasted_bits():
    n = 16
    left = np.array([100, 110, 125, 138, 150, 160, 171, 180, 190, 201, 210, 222, 230, 241, 250, 260])
    right = left - np.arange(n) * 4
    side = left - right  # multiples of 4: two wasted bits
    w = Writer()
    w.put(0b0_100001_0, 8)  # LPC of order 2
    for x in left[:2]:
        w.put(int(x), 16)
    w.put(3, 4), w.put(1, 5), w.put(4, 4), w.put(-2 & 15, 4)  # precision 4, shift 1, factors 4 and -2: x = 2a - b
    w.put(0, 2), w.put(1, 4), w.put(2, 4)  # 4-bit parameters, two partitions
    residual = [int(left[i] - ((4 * left[i - 1] - 2 * left[i - 2]) >> 1)) for i in range(2, n)]
    for r in residual[:6]:
        w.rice(r, 2)
    w.put(15, 4), w.put(6, 5)  # escape: six raw bits
    for r in residual[6:]:
        w.put(r & 63, 6)
    w.put(0b0_001001_1, 8), w.put(1, 2)  # fixed predictor of order 1, two wasted bits: unary 01
    small = side >> 2
    w.put(int(small[0]), 15)
    w.put(1, 2), w.put(0, 4), w.put(1, 5)  # 5-bit parameters
    for d in np.diff(small):
        w.rice(int(d), 1)
    head = bytes([0xFF, 0xF8, 0x69, 0x88, 0x00, n - 1])  # 8-bit size, left and side, 16 bits
    pcm = np.stack([left, right], 1).astype("<i2").tobytes()
    s = flac.decode([stream_of(w.bytes(), head, 16, 2, n, hashlib.md5(pcm).digest())])[0]
    assert s.error == "" and s.ok
    assert s.samples[0].tolist() == left.tolist() and s.samples[1].tolist() == right.tolist()
    assert flac.pcm(s) == pcm and flac.pcm(s, 3, 5) == pcm[12:20]


def test_flac_samples_that_look_like_a_header():
    next_header = bytes([0xFF, 0xF8, 0x61, 0x02, 0x01, 15])  # 16 samples, one channel, 8 bits, frame 1
    crc = flac.crc_ranges(np.frombuffer(next_header, np.uint8), np.array([0]), np.array([6]), 8)[0]
    held = next_header + bytes([int(crc)])
    samples = np.frombuffer(b"\x05\x06" + held + bytes(range(16 - 2 - len(held))), np.int8)
    w = Writer()
    w.put(0b0_000001_0, 8)  # verbatim
    for x in samples:
        w.put(int(x) & 255, 8)
    head = bytes([0xFF, 0xF8, 0x61, 0x02, 0x00, 15])
    raw = stream_of(w.bytes(), head, 8, 1, 16, hashlib.md5(samples.tobytes()).digest())
    assert len(flac._frames(raw, raw.index(head), 8)[0]) == 2  # the look-alike splits the frame
    bad = bytearray(raw)
    bad[-3] ^= 1
    s, damaged = flac.decode([raw, bytes(bad)])
    assert s.ok and s.samples[0].tolist() == samples.tolist()
    assert damaged.error == "frame checksum"


def test_flac_blocks(spark):
    raw = payloads()[3]
    media = spark.createDataFrame([(1, flac.encode([raw])[0]), (2, b"bad"), (3, None)], "doc_id long, media binary")
    rows = flac.blocks(media).orderBy("key", "block").collect()
    one = [r for r in rows if r.key == "1"]
    assert [r.sample_offset for r in one] == list(range(0, len(raw), 576))
    assert b"".join(bytes(r.pcm) for r in one) == (np.frombuffer(raw, np.uint8) ^ 0x80).tobytes()
    assert [(r.key, r.block, r.ok) for r in rows[len(one) :]] == [("2", None, False), ("3", None, False)]
    texts = spark.createDataFrame([(1, "héllo " * 300), (2, None)], "doc_id long, text string")
    digests = {r.doc_id: r.media_sha256 for r in flac.store(texts).collect()}
    assert {r.doc_id: hashlib.sha256(r.media).hexdigest() for r in flac.streams(texts).collect()} == digests


def test_flac_rows(spark):
    rows = [(1, "hé"), (2, "hé"), (3, None), (4, "z" * 5000)]
    got = {r.doc_id: r for r in flac.store(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows:
        data = (t or "").encode()
        full = data + b"\xff" * (-len(data) % 576 if data else 576)
        assert (got[i].n_bytes, got[i].payload_bytes, got[i].payload_sha256, got[i].tail_crc32) == (len(data), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-32:]))
        assert got[i].verified
    assert tuple(got[1])[1:] == tuple(got[2])[1:]


# ---------------------------------------------------------------- pipeline


def test_pipeline(spark, tmp_path):
    rng = random.Random(7)
    words = {"en": "the of and to in is that for was with on as".split(), "de": "der die und das nicht mit auf ein eine zu den von".split()}
    texts = [(lang, " ".join(rng.choice(words[lang]) + rng.choice(["", "a", "en"]) for _ in range(60))) for lang in ("en", "de") for _ in range(80)]
    rows = [(i, t, lang, f"s{i % 3}", len(t)) for i, (lang, t) in enumerate(texts)]
    rows += [(1000, rows[0][1], "en", "s0", 1), (1001, "12345 67890", None, "s1", 11), (1002, rows[5][1] + " token=abcdefghijklmnop1", "en", "s2", 9)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        ids = {r.doc_id for r in docs.collect()}
        if name == "language":
            assert 1001 not in ids and len(ids) == len(rows) - 1
        if name == "near_duplicates":
            assert 1000 not in ids and 0 in ids
        if name == "secret_scan":
            assert not docs.where("text like '%token=abc%'").count()
    assert docs.count() == corpus_pipeline.run(spark, str(tmp_path)).count()
    assert corpus_pipeline.ORACLE_SQL is None
