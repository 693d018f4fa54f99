"""Near duplicates by DartMinHash signatures, banded joining and an exact check.

A text is its set of five-word shingles (words: runs of ASCII letters, digits and
non-ASCII characters, lower-cased).  The plane of weight x rank is cut into unit cells;
each (element, cell) gets a hashed Poisson number of darts, each with a hashed weight,
rank and coordinate.  A text keeps, for every one of K coordinates, the earliest dart that
falls into the regions of its elements: [0, weight) x [0, limit), with the limit set so
that K ln K + 2K darts are expected however long the text is.  Two texts keep the same
dart in a coordinate with the probability of their weighted Jaccard similarity.

Equal texts are one node, known by its digest.  Nodes that share a band meet the band's
smallest member: a sketch of the signature (four bits a coordinate) turns most unlike pairs
away before any set moves, and the rest are compared exactly (Jaccard >= 0.8).  Where the
other members of a band are still in several classes, their rarest shingles take the place
of the bands: two texts that reach 0.8 share one of the 20 % rarest of each, and shingles
that one text alone has bound what it can share with any other.  The members of a shingle
get a hashed rank below their number; those below 8, then 32, 128 ... meet all that rank
above them, until every pair of different classes was compared, ruled out or joined.  So a
group of copies is neither gathered in one task nor paired with itself.

Null texts are never linked; texts without a word are linked only to equal texts; texts of
one to four words are one shingle; repeated rows share a class; an empty table gives an
empty result; other columns are ignored.  ``class_id`` is the class's smallest doc_id.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import counted, cut, map_rows, release

SHINGLE, SIMILARITY = 5, 0.8
#: What two texts at SIMILARITY share, as a part of the sum of their sizes.
SHARE = SIMILARITY / (1 + SIMILARITY)
#: Coordinates of a signature, and how many make a band: a pair at 0.8 is missed once in 300,000.
K, BAND = 96, 4
#: Bytes of text that are worked on at a time.
CHUNK = 1 << 19
#: Most coordinates in which the sketches of a pair at SIMILARITY differ: 18 are expected,
#: more than 40 of 96 differ once in 17 million (the sum of the binomial's tail).
SKETCH_APART = 40
#: Rows up to which a table of node keys (some 60 bytes each) is broadcast, by its counted size.
BROADCAST_ROWS = 250_000
#: Members of a shingle that lead in the first round; each further round has four times as many.
LEADERS = 8
#: Edges up to which components are found in one task (some 100 bytes each there).
EDGES = 500_000

_G = np.uint64(0x9E3779B97F4A7C15)
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
_POISSON = np.array([sum(math.exp(-1) / math.factorial(i) for i in range(n + 1)) for n in range(12)])


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(2)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2**64."""
    base = 0xD6E8FEB86659FD93
    up, down = np.full(size, np.uint64(base)), np.full(size, np.uint64(pow(base, -1, 1 << 64)))
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of the texts, and the text that each stands in."""
    raw = [t.lower().encode() for t in texts]
    data = np.frombuffer(b"\0".join([b"", *raw, b""]), np.uint8)
    word = _WORD[data]
    change = np.flatnonzero(word[1:] != word[:-1]) + 1
    start, end = change[::2], change[1::2]
    up, down = _powers(1 << max(20, int(len(data)).bit_length()))
    total = np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)])
    hashes = mix64((total[end - 1] - total[start - 1]) * down[start] + (end - start).astype(np.uint64))
    bounds = np.cumsum([1 + len(r) for r in raw])
    return hashes, np.searchsorted(bounds, start, side="right")


def shingles(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of the texts, repeats kept, and the text of each; texts in order."""
    hashes, owner = word_hashes(texts)
    count = np.bincount(owner, minlength=len(texts))
    first = np.cumsum(count) - count
    factor = mix64(_G * np.arange(1, SHINGLE + 1, dtype=np.uint64)) | np.uint64(1)
    whole = np.flatnonzero(owner[: len(owner) - SHINGLE + 1] == owner[SHINGLE - 1 :]) if len(owner) >= SHINGLE else np.zeros(0, np.int64)
    value = np.zeros(len(whole), np.uint64)
    for j in range(SHINGLE):
        value += hashes[whole + j] * factor[j]
    short = np.flatnonzero((count > 0) & (count < SHINGLE))
    extra = np.zeros(len(short), np.uint64)
    for j in range(SHINGLE - 1):
        has = count[short] > j
        extra[has] += hashes[first[short[has]] + j] * factor[j]
    extra += count[short].astype(np.uint64)
    out, which = np.concatenate([mix64(value), mix64(extra)]), np.concatenate([owner[whole], short])
    order = np.argsort(which, kind="stable") if len(short) else slice(None)
    return out[order], which[order]


def dart_signature(element: np.ndarray, weight: np.ndarray | None, owner: np.ndarray, texts: int, k: int = K) -> np.ndarray:
    """(texts, k) signatures of weighted sets; rows of texts without elements are 0.

    ``weight`` None: every element weighs 1 (repeats of an element throw the same darts and
    change nothing).  ``owner`` is ascending.
    """
    out = np.zeros((texts, k), np.uint64)
    if not len(element):
        return out
    mass = np.bincount(owner, weights=weight, minlength=texts)
    limit = (k * math.log(k) + 2 * k) / np.maximum(mass, 1e-9)
    todo = np.flatnonzero(mass > 0)
    while len(todo):  # a text with an empty coordinate throws again, twice as far
        active = np.zeros(texts, bool)
        active[todo] = True
        own = np.flatnonzero(active[owner])
        high = np.maximum(np.ceil(limit[owner[own]]), 1).astype(np.int64)
        wide = np.ones(len(own), np.int64) if weight is None else np.maximum(np.ceil(weight[own]), 1).astype(np.int64)
        cells = high * wide
        item = np.repeat(np.arange(len(own)), cells)
        number = np.arange(len(item)) - np.repeat(np.cumsum(cells) - cells, cells)
        rank0, weight0 = number % high[item], number // high[item]
        seed = mix64(element[own[item]] + _G * (rank0.astype(np.uint64) + (weight0.astype(np.uint64) << np.uint64(32)) + np.uint64(1)))
        darts = np.searchsorted(_POISSON, (seed >> np.uint64(11)) * 2.0**-53, side="right")
        cell = np.repeat(np.arange(len(item)), darts)
        turn = np.arange(len(cell)) - np.repeat(np.cumsum(darts) - darts, darts)
        dart = mix64(seed[cell] + _G * (turn.astype(np.uint64) + np.uint64(7)))
        spot = mix64(dart + _G)
        rank = rank0[cell] + (spot >> np.uint64(11)) * 2.0**-53
        who = owner[own[item[cell]]]
        keep = rank < limit[who]
        if weight is not None:
            keep &= weight0[cell] + (dart & np.uint64(0xFFFFFF)) * 2.0**-24 < weight[own[item[cell]]]
        dart, rank, who = dart[keep], rank[keep], who[keep]
        place = who * k + (((dart >> np.uint64(40)) * np.uint64(k)) >> np.uint64(24)).astype(np.int64)
        order = np.argsort(-rank, kind="stable")
        table = np.zeros(texts * k, np.uint64)
        table[place[order]] = dart[order] | np.uint64(1)  # the earliest is written last
        table = table.reshape(texts, k)
        full = todo[(table[todo] != 0).all(1)]
        out[full] = table[full]
        todo = todo[(table[todo] == 0).any(1)]
        limit[todo] *= 2
    return out


def bands(signature: np.ndarray, width: int = BAND) -> np.ndarray:
    """One hash for each band of a signature."""
    rows, k = signature.shape
    by_band = signature.reshape(rows, k // width, width)
    value = np.zeros((rows, k // width), np.uint64) + _G * np.arange(1, k // width + 1, dtype=np.uint64)
    for j in range(width):
        value = mix64(value ^ by_band[:, :, j]) + _G
    return value


def sketch(signature: np.ndarray) -> np.ndarray:
    """Four hashed bits of each coordinate, sixteen coordinates in a 64-bit integer."""
    bits = mix64(signature) >> np.uint64(60)
    rows, k = bits.shape
    shift = np.arange(16, dtype=np.uint64) * np.uint64(4)
    return (bits.reshape(rows, k // 16, 16) << shift).sum(2, dtype=np.uint64)


def _groups(texts: list[str]):
    """Runs of texts of about CHUNK bytes."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > CHUNK:
            yield first, i
            first, size = i, 0
        size += len(t)
    if first < len(texts):
        yield first, len(texts)


def shingle_sets(texts: list[str]) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    out = []
    for a, b in _groups(texts):
        element, owner = shingles(texts[a:b])
        ends = np.searchsorted(owner, np.arange(b - a + 1))
        out += [np.unique(element[i:j]) for i, j in zip(ends[:-1], ends[1:], strict=True)]
    return out


def _node() -> F.Column:
    return F.unhex(F.md5(F.col("text").cast("binary")))


def signed(docs: DataFrame) -> DataFrame:
    """doc_id, node (digest of the text), n (distinct shingles), bands and sketch of every document with a text."""

    def step():
        def work(rows):
            texts, n, found, drawn = rows["text"], [], [], []
            for a, b in _groups(texts):
                sets = shingle_sets(texts[a:b])
                count = np.array([len(x) for x in sets])
                signature = dart_signature(np.concatenate(sets), None, np.repeat(np.arange(b - a), count), b - a)
                n += count.tolist()
                found += [row if c else [] for row, c in zip(bands(signature).view(np.int64), count, strict=True)]
                drawn += list(sketch(signature).view(np.int64))
            return {"doc_id": rows["doc_id"], "node": rows["node"], "n": n, "bands": found, "sketch": drawn}

        return work

    rows = docs.where(F.col("text").isNotNull()).select("doc_id", "text").withColumn("node", _node())
    return map_rows(rows, ["doc_id", "node", "text"], "doc_id long, node binary, n int, bands array<long>, sketch array<long>", step)


def _small(df: DataFrame, n: int) -> DataFrame:
    return F.broadcast(df) if n <= BROADCAST_ROWS else df


def _sets(docs: DataFrame, nodes: DataFrame, count: int) -> DataFrame:
    """(nid, shingles): sorted distinct shingle hashes of one document of each wanted node.

    Of copied texts the first doc_id's row is taken, and one of these if it repeats; the
    texts of other nodes, nearly all, aren't shuffled for that.
    """

    def step():
        def work(rows):
            return {"nid": rows["nid"], "shingles": [x.view(np.int64) for x in shingle_sets(rows["text"])]}

        return work

    texts = docs.where(F.col("text").isNotNull()).select("doc_id", "text").withColumn("node", _node())
    wanted = _small(nodes.select("nid", F.col("node").alias("want"), "first_doc", "copies"), count)
    found = texts.join(wanted, (F.col("node") == F.col("want")) & ((F.col("copies") == 1) | F.col("doc_id").eqNullSafe(F.col("first_doc"))))
    one = found.where("copies = 1").select("nid", "text").unionByName(found.where("copies > 1").select("nid", "text").dropDuplicates(["nid"]))
    return map_rows(one, ["nid", "text"], "nid long, shingles array<long>", step)


def _apart() -> F.Column:
    """In how many coordinates the sketches sa and sb differ."""
    parts = []
    for i in range(K // 16):
        x = F.col("sa")[i].bitwiseXOR(F.col("sb")[i])
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        parts.append(F.bit_count(x.bitwiseAND(F.lit(0x1111111111111111))))
    return sum(parts[1:], parts[0])


def _links(pairs: DataFrame, sets: DataFrame, sketches: DataFrame, nodes: int) -> DataFrame:
    """(u, v): the labels (ca, cb) of distinct pairs (a, b) whose Jaccard similarity reaches SIMILARITY.

    Sketches turn pairs away first.  Of those left b's set moves once for each partner; a's,
    which may lead thousands of pairs, moves once a task that has such pairs.
    """

    def step():
        def work(rows):
            u, v = [], []
            for x, y, left, right in zip(rows["ca"], rows["cb"], rows["left"], rows["right"], strict=True):
                p, q = np.array(left, np.int64).view(np.uint64), np.array(right, np.int64).view(np.uint64)
                at = np.searchsorted(q, p)
                both = int((q[np.minimum(at, len(q) - 1)] == p).sum())
                if both >= SIMILARITY * (len(p) + len(q) - both) - 1e-9:
                    u.append(max(x, y))
                    v.append(min(x, y))
            return {"u": u, "v": v}

        return work

    known = _small(sketches.select(F.col("nid").alias("a"), F.col("sketch").alias("sa")), nodes), _small(sketches.select(F.col("nid").alias("b"), F.col("sketch").alias("sb")), nodes)
    near = pairs.join(known[0], "a").join(known[1], "b").where(_apart() <= SKETCH_APART).select("a", "b", "ca", "cb")
    left, right = sets.select(F.col("nid").alias("a"), F.col("shingles").alias("left")), sets.select(F.col("nid").alias("b"), F.col("shingles").alias("right"))
    both = near.join(right, "b").join(left, "a")
    return map_rows(both, ["ca", "cb", "left", "right"], "u long, v long", step).where("u <> v").dropDuplicates()


def _union(edges: DataFrame) -> DataFrame:
    """Components of a bounded number of edges by union-find in one task."""

    def run(batches):
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while root.setdefault(x, x) != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for batch in batches:
            for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a, b = find(u), find(v)
                root[max(a, b)] = min(a, b)
        nids = list(root)
        yield pa.RecordBatch.from_arrays([pa.array(nids, pa.int64()), pa.array([find(x) for x in nids], pa.int64())], names=["nid", "comp"])

    return edges.select("u", "v").coalesce(1).mapInArrow(run, "nid long, comp long")


def _stars(edges: DataFrame) -> DataFrame:
    """Components of any number of edges (u > v), by large and small stars.

    Each turn is two aggregations and joins on the edges; the table written in between
    cuts the lineage.  At the end every node points at its component's smallest.
    """
    state = None
    while True:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).dropDuplicates()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        ends = F.array(F.struct(F.col("u").alias("x"), F.col("m").alias("y")), F.struct(F.col("v").alias("x"), F.col("m").alias("y")))
        small = large.join(lowest, "u").select(F.explode(ends).alias("e")).select(F.greatest("e.x", "e.y").alias("u"), F.least("e.x", "e.y").alias("v"))
        edges = cut(small.where("u <> v").dropDuplicates())
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    return edges.groupBy("u").agg(F.min("v").alias("comp")).select(F.col("u").alias("nid"), "comp").unionAll(edges.select(F.col("v").alias("nid"), F.col("v").alias("comp")).dropDuplicates())


def components(edges: DataFrame, most: int | None = None) -> DataFrame:
    """(nid, comp): the smallest node of each connected component of the edges (a, b);
    isolated nodes have no row."""
    ends = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    return _components(*counted(ends.dropDuplicates(), 16), most)[0]


def _components(edges: DataFrame, n: int, most: int | None = None) -> tuple[DataFrame, int]:
    """(nid, comp) and its number of rows, for n written edges (u, v) with u > v.

    Up to ``most`` edges (EDGES if not given) meet in one task, which they fit easily; more
    go through stars.  Both give the same rows.
    """
    return counted(_union(edges) if n <= (EDGES if most is None else most) else _stars(edges), 16)


def _close(a: str, b: str) -> F.Column:
    """Whether sets of these sizes can reach SIMILARITY."""
    return (F.col(a) >= SIMILARITY * F.col(b) - 1e-9) & (F.col(b) >= SIMILARITY * F.col(a) - 1e-9)


def _classed(rows: DataFrame, comps: DataFrame, n: int, label: str) -> DataFrame:
    """Rows with their label's component as comp, or the label itself where it is not linked."""
    moved = _small(comps.select(F.col("nid").alias("_was"), F.col("comp").alias("_to")), n)
    joined = rows.join(moved, F.col(label) == F.col("_was"), "left")
    return joined.withColumns({"comp": F.coalesce("_to", label), "linked": F.col("_to").isNotNull()}).drop("_was", "_to")


def _mixed(members: DataFrame, above: int = 0) -> DataFrame:
    """(bucket, size): the buckets of more than ``above`` members, of several classes."""
    classes_ = members.groupBy("bucket").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count(F.lit(1)).alias("size"))
    return classes_.where((F.col("x") != F.col("y")) & (F.col("size") > above)).select("bucket", "size")


def classes(docs: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """(rows, nodes, count): rows(doc_id, node) of documents with a text; for every node that
    isn't alone its class, nodes(node, first_doc, copies, class_id, keeper), and their count."""
    rows = cut(signed(docs))
    nodes = rows.groupBy("node").agg(F.min("doc_id").alias("first_doc"), F.count(F.lit(1)).alias("copies"), *[F.first(c).alias(c) for c in ("n", "bands", "sketch")])
    nodes, _ = counted(nodes.withColumn("nid", F.monotonically_increasing_id()), 300)
    members = nodes.select("nid", "n", F.explode("bands").alias("bucket"))
    heads = members.groupBy("bucket").agg(F.min(F.struct("nid", "n")).alias("head"), F.count(F.lit(1)).alias("size")).where("size > 1")
    members, _ = counted(members.join(heads, "bucket").where("nid <> head.nid").select("bucket", "nid", "n", F.col("head.nid").alias("head"), F.col("head.n").alias("head_n")), 48)
    ends = members.select("nid").unionAll(members.select(F.col("head").alias("nid"))).dropDuplicates()
    wanted, count = counted(nodes.join(ends, "nid", "left_semi").select("nid", "node", "first_doc", "copies", "sketch"), 120)
    sets = cut(_sets(docs, wanted, count))
    sketches = wanted.select("nid", "sketch")
    pairs = members.where(_close("n", "head_n")).select(F.col("head").alias("a"), F.col("nid").alias("b")).dropDuplicates()
    links, edges = counted(_links(pairs.withColumns({"ca": F.col("a"), "cb": F.col("b")}), sets, sketches, count), 16)
    comps, n = _components(links, edges)
    left = _classed(members.select("bucket", "nid", "n"), comps, n, "nid")
    open_, several = counted(left.join(_mixed(left).select("bucket"), "bucket", "left_semi").select("nid", "n", "comp").dropDuplicates(), 40)
    release(members)
    more = _rounds(open_, several, sets, sketches, count) if several else []
    if more:
        for each in more:
            links = links.unionAll(each)
        comps, n = _components(*counted(links.dropDuplicates(), 16))
    known = _classed(nodes.select("nid", "node", "first_doc", "copies"), comps, n, "nid").where("linked or copies > 1")
    best = known.groupBy("comp").agg(F.min(F.struct(F.col("first_doc").isNull().alias("none"), "first_doc", "nid")).alias("best"))
    known = known.join(best, "comp").select("node", "first_doc", "copies", F.col("best.first_doc").alias("class_id"), (F.col("nid") == F.col("best.nid")).alias("keeper"))
    known, size = counted(known, 60)
    release(nodes, wanted, sets, comps, open_, *more)
    return rows.select("doc_id", "node"), known, size


def _rounds(open_: DataFrame, several: int, sets: DataFrame, sketches: DataFrame, count: int) -> list[DataFrame]:
    """Links (u, v) between the classes of the open nodes (nid, n, comp), round by round.

    Places bound a pair from each shingle that it meets in: what the two share up to there
    is at most the smaller place without shingles of one node, and after it at most the
    smaller rest.  A pair stays only if each of these bounds allows SIMILARITY.
    """
    buckets, rows = counted(_possible(open_, several, sets), 60)
    low, high, found = 0, LEADERS, []
    while rows:
        leader = buckets.where((F.col("rank") >= low) & (F.col("rank") < high))
        leader = leader.select(F.col("bucket").alias("_b"), *[F.col(c).alias(f"{c}_a") for c in ("nid", "comp", "rank", "n", "u", "place")])
        shared = F.least(F.col("n") - F.col("u"), F.col("n_a") - F.col("u_a"))
        needed = SHARE * (F.col("n") + F.col("n_a")) - 1e-9
        later = F.struct("rank", "nid") > F.struct("rank_a", "nid_a")
        early = ((F.col("n") > F.col("n_a")) | _early("place", "n")) & ((F.col("n_a") > F.col("n")) | _early("place_a", "n_a"))
        met = buckets.join(_small(leader, rows), (F.col("bucket") == F.col("_b")) & later & (F.col("comp") != F.col("comp_a")) & early & (shared >= needed))
        most = F.least(F.col("place") - F.col("u"), F.col("place_a") - F.col("u_a")) + F.least(F.col("n") - F.col("place"), F.col("n_a") - F.col("place_a"))
        pairs = met.groupBy(F.col("nid_a").alias("a"), F.col("nid").alias("b"), F.col("comp_a").alias("ca"), F.col("comp").alias("cb")).agg(F.min(most - needed).alias("over")).where("over >= 0").drop("over")
        links, edges = counted(_links(pairs, sets, sketches, count), 16)
        comps, n = _components(links, edges)
        found.append(links)
        low, high = high, 4 * high
        before = buckets
        now = _classed(buckets.withColumnRenamed("comp", "was"), comps, n, "was").drop("was", "size", "linked")
        buckets, rows = counted(now.join(_small(_mixed(now, low), rows), "bucket"), 60)
        release(before, comps)
    release(buckets)
    return found


def _early(place: str, n: str) -> F.Column:
    """Whether a shingle's place among those of a set is one that a larger partner must share."""
    return F.col(place) <= F.col(n) - F.ceil(2 * SHARE * F.col(n) - 1e-9) + 1


def _possible(open_: DataFrame, several: int, sets: DataFrame) -> DataFrame:
    """Where open nodes may still reach SIMILARITY: (bucket, nid, n, u, place, comp, size, rank) by shingle.

    u counts the shingles that no other open node has.  They are in no intersection, so two
    nodes share at most n - u and have to share 0.8 of the larger at least; nodes that can't
    are left out.  Of the others each takes its rarest shingles, one more than it may lack in
    a partner: any two that reach SIMILARITY have one of these in common.  A node's rank
    in a shingle is its hash, stretched to the shingle's number of members: ranks need no
    sort, and shingles of the same members have the same leaders, whose pairs count once.
    """
    own = sets.join(_small(open_, several), "nid").select("nid", "n", "comp", F.explode("shingles").alias("s"))
    often = own.groupBy("s").agg(F.count(F.lit(1)).alias("k"))
    by_rarity = W.partitionBy("nid").orderBy("k", "s")  # one sort serves both
    alone = F.sum((F.col("k") == 1).cast("int")).over(by_rarity.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    rows = own.join(often, "s").withColumns({"u": alone, "place": F.row_number().over(by_rarity)})
    needed = F.ceil(SIMILARITY * F.col("n") - 1e-9)
    rows = rows.where((F.col("n") - F.col("u") >= needed) & (F.col("place") <= F.col("n") - needed + 1) & (F.col("k") > 1))
    members = cut(rows.select(F.col("s").alias("bucket"), "nid", "n", "u", "place", "comp"))
    draw = F.shiftrightunsigned(F.xxhash64("nid"), 11) * F.lit(2.0**-53)
    return members.join(_mixed(members), "bucket").withColumn("rank", draw * F.col("size"))


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, class_id, keep: one row a document; one document of a class is kept.

    Rows that repeat the kept document's doc_id and text are that document, and marked alike.
    """
    rows, nodes, count = classes(docs)
    table = _small(nodes.select(F.col("node").alias("known"), "class_id", "keeper", "first_doc"), count)
    found = rows.join(table, F.col("node") == F.col("known"), "left")
    keep = F.col("known").isNull() | (F.col("keeper") & F.col("doc_id").eqNullSafe(F.col("first_doc")))
    with_text = found.select("doc_id", F.when(F.col("known").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), keep.alias("keep"))
    without = docs.where(F.col("text").isNull()).select("doc_id", F.col("doc_id").alias("class_id"), F.lit(True).alias("keep"))
    return with_text.unionByName(without)


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents without all but one of each class; columns as they come.

    Of rows that repeat a kept document's doc_id and text only one stays.
    """
    rows, nodes, count = classes(docs)
    release(rows)
    gone = nodes.where(~F.col("keeper")).select("node", F.lit(None).cast("long").alias("first_doc"), F.lit(False).alias("keeper"))
    many = nodes.where(F.col("keeper") & (F.col("copies") > 1)).select("node", "first_doc", "keeper")
    table = gone.unionByName(many).select(F.col("node").alias("_known"), F.col("first_doc").alias("_first"), F.col("keeper").alias("_keeper"))
    names = docs.columns
    marked = docs.withColumn("_node", _node()).join(_small(table, count), F.col("_node") == F.col("_known"), "left")
    alone = marked.where(F.col("_known").isNull()).select(*names)
    copied = marked.where(F.col("_keeper") & F.col("doc_id").eqNullSafe(F.col("_first"))).dropDuplicates(["_node"]).select(*names)
    return alone.unionByName(copied)
