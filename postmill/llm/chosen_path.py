"""N-gram Jaccard join by chosen paths.

Texts become sets of hashed five-word shingles; equal sets are one *text* from then on. A text's
set is embedded as ``COORDINATES`` MinHash values, two texts agreeing in a coordinate with their
Jaccard similarity. A run of the join begins at a coordinate of its own, at which texts of equal
value meet, and walks a random tree from there: each node picks coordinates with probability
1/(t * coordinates) each, t being the threshold, and a text goes on into the child named by its
value there, so a text's paths are its own to compute and only texts that share values meet.
Texts at the same node after ``DEPTH`` choices form a bucket, which is brute-forced on four-bit
MinHash sketches. Runs are repeated until a pair at the threshold has met with probability
``RECALL``.

Buckets of more than ``BUCKET`` texts are first compared with their smallest text. What is then
known to be in one likely group needs no further comparison in that bucket; if few others are in
it, they are compared with all of it, dealt out in blocks; else the bucket is split further, by
joining its members with their MinHash values again. As deeper walks lose more, the texts of
buckets that are split walk further runs, as many as the deepest level requires.

Bucket results leave as stars (text, smallest text of its likely group), never as all pairs. Their
connected components, which only collect what might be similar, are then decided exactly:
components are dealt out in blocks, each pair of blocks compares its texts by true set
intersections and sends back link counts per text and a star of exact links. Connected components
of the exact links are the classes.

Texts without words are alone, unless the whole text is the same, not blank and not null. Repeated
rows are copies of each other. Rows with a null id take no part: their class is null and they have
no links. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .shared import groups, lists, text_batches, written
from .tokens import LETTERS, hash_words, mix, raw_bytes, shingles

SHINGLE = 5
THRESHOLD = 0.8
COORDINATES = 64
DEPTH = 3
BUCKET = 512
DEEPEST = 12
RECALL = 0.99
BLOCK = 256
#: Ids that may be broadcast, of 16 bytes or so each.
MOST_IDS = 500_000
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def runs_needed(recall: float = RECALL, depth: int = DEPTH, threshold: float = THRESHOLD) -> int:
    """Runs until a pair at the threshold has shared a path of ``depth`` with the given probability.

    A run's first choice is a coordinate in which the pair agrees or not. At every later node such a pair has
    one common child on average, Poisson distributed; more or fewer where it agrees in more or fewer
    coordinates than expected, which all runs share."""
    agree = np.arange(COORDINATES + 1)
    weight = np.array([math.comb(COORDINATES, k) * threshold**k * (1 - threshold) ** (COORDINATES - k) for k in agree])
    p = np.ones(COORDINATES + 1)
    for _ in range(depth - 1):
        p = 1 - np.exp(-p * agree / (COORDINATES * threshold))
    p *= agree / COORDINATES
    runs = 1
    while runs < 1000 and (weight * (1 - p) ** runs).sum() > 1 - recall:
        runs += 1
    return runs


# ---- sets -------------------------------------------------------------------------------------


def _unit(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(11)).astype(np.float64) / (1 << 53)


_SEEDS = mix(np.arange(1, COORDINATES + 1, dtype=np.uint64) * _GOLD)


def minhash(values: np.ndarray) -> np.ndarray:
    """MinHash values (32 bits each) of one non-empty set of 64-bit hashes."""
    out = np.full(COORDINATES, np.iinfo(np.uint64).max, np.uint64)  # the high halves tell sets apart well enough
    for a in range(0, len(values), 4096):
        part = values[a : a + 4096]
        x = (part[:, None] ^ _SEEDS[None, :]) * np.uint64(0xFF51AFD7ED558CCD)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xC4CEB9FE1A85EC53)
        np.minimum(out, x.min(axis=0), out=out)
    return (out >> np.uint64(32)).astype(np.uint32)


def _sets(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row, ascending; row offsets. A row without words but with text is its bytes' hash."""
    words, rows = hash_words(col, LETTERS)
    values, offsets = shingles(words, rows, SHINGLE)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    bare = np.flatnonzero(np.diff(offsets) == 0)
    if len(bare):
        data, at = raw_bytes(col)
        extra, extra_row = [], []
        for r in bare:
            raw = data[at[r] : at[r + 1]].tobytes()
            if raw.strip():
                extra.append(np.frombuffer(hashlib.sha256(raw).digest()[:8], np.uint64)[0])
                extra_row.append(r)
        values = np.concatenate([values, np.array(extra, np.uint64)])
        row = np.concatenate([row, np.array(extra_row, np.int64)])
    order = np.lexsort((values, row))
    values, row = values[order], row[order]
    keep = np.ones(len(values), bool)
    keep[1:] = (values[1:] != values[:-1]) | (row[1:] != row[:-1])
    values, row = values[keep], row[keep]
    return values, np.searchsorted(row, np.arange(len(offsets)))


def _described(batches):
    """(id, low, high, n, mark): two hashes of the row's set, its size and MinHash values; null hashes where it is empty."""
    with np.errstate(over="ignore"):
        for batch in batches:
            values, offsets = _sets(batch.column(1))
            n = np.diff(offsets)
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(values))])
            other = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(mix(values) + _GOLD))])
            low, high = total[offsets[1:]] - total[offsets[:-1]], other[offsets[1:]] - other[offsets[:-1]]
            marks = [minhash(values[a:b]) for a, b in zip(offsets[:-1], offsets[1:]) if b > a]
            flat = np.concatenate(marks) if marks else np.empty(0, np.uint32)
            ends = np.concatenate([[0], np.cumsum(n > 0)]) * COORDINATES
            none = n == 0
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(low.view(np.int64), mask=none), pa.array(high.view(np.int64), mask=none), pa.array(n, pa.int32()), lists(flat.view(np.int32), ends, pa.int32())],
                names=["id", "low", "high", "n", "mark"])


def _set_rows(batches):
    """The text column, second, as its set; the others as they are."""
    for batch in batches:
        values, offsets = _sets(batch.column(1))
        yield pa.RecordBatch.from_arrays([batch.column(0), lists(values.view(np.int64), offsets, pa.int64()), *batch.columns[2:]],
                                         names=["text_id", "shingles", *batch.schema.names[2:]])


# ---- paths ------------------------------------------------------------------------------------


def _step(path: np.ndarray, who: np.ndarray, marks: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Children of nodes ``path`` for the texts ``who``: a node's own hash decides which coordinates it picks."""
    u = _unit(mix(path ^ np.uint64(0xA5A5A5A5A5A5A5A5)))
    mean, chance, total = 1 / threshold, math.exp(-1 / threshold), 0.0
    count = np.zeros(len(path), np.int64)
    for k in range(1, 12):
        total += chance
        count += u >= total
        chance *= mean / k
    at = np.repeat(np.arange(len(path)), count)
    nth = np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count)
    # the nth choice is a node of its own, even of a coordinate that was chosen before
    choice = mix(path[at] + (nth.astype(np.uint64) + np.uint64(1)) * _GOLD)
    child = choice ^ mix(marks[who[at], (choice % np.uint64(COORDINATES)).astype(np.int64)])
    return mix(child), who[at]


def _marks(batch: pa.RecordBatch, name: str = "mark") -> np.ndarray:
    return batch.column(name).flatten().to_numpy(zero_copy_only=False).view(np.uint32).astype(np.uint64).reshape(-1, COORDINATES)


def _emit(batch, path, who, sketch):
    cols = [pa.array(path.view(np.int64)), batch.column("text_id").take(pa.array(who)), batch.column("n").take(pa.array(who)),
            pa.array([sketch[w] for w in who], pa.binary())]
    return pa.RecordBatch.from_arrays(cols, names=["bucket", "text_id", "n", "sketch"])


def _sketches(marks: np.ndarray) -> list[bytes]:
    small = (mix(marks) & np.uint64(15)).astype(np.uint8)
    return [r.tobytes() for r in small[:, ::2] << 4 | small[:, 1::2]]


def _walk(start: int, runs: int, depth: int, threshold: float):
    """Runs ``start`` up to ``runs``, to ``depth``."""

    def apply(batches):
        with np.errstate(over="ignore"):
            for batch in batches:
                marks = _marks(batch)
                n = len(marks)
                number = np.repeat(np.arange(start, runs), n)
                who = np.tile(np.arange(n), runs - start)
                path = mix((number + 1).astype(np.uint64) * np.uint64(0x51ED270B)) ^ mix(marks[who, number % COORDINATES])
                for _ in range(depth - 1):
                    path, who = _step(path, who, marks, threshold)
                # a text that meets a node twice is there once
                pairs = np.unique(np.stack([path, who.astype(np.uint64)]), axis=1) if len(path) else np.empty((2, 0), np.uint64)
                yield _emit(batch, np.ascontiguousarray(pairs[0]), pairs[1].astype(np.int64), _sketches(marks))

    return apply


def _split(threshold: float):
    def apply(batches):
        with np.errstate(over="ignore"):
            for batch in batches:
                marks = _marks(batch)
                path = batch.column("bucket").to_numpy(zero_copy_only=False).view(np.uint64)
                path, who = _step(path, np.arange(len(path)), marks, threshold)
                yield _emit(batch, path, who, _sketches(marks))

    return apply


_BUCKETS = "bucket bigint, text_id bigint, n int, sketch binary"


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest member of each one's component, given links as arrays of positions."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if np.array_equal(new, root):
            return root
        root = new


def _likely(least: float, threshold: float):
    """Stars of texts whose sketches agree in ``least`` of the coordinates and whose sizes allow the threshold."""

    def apply(batches):
        for _, table in groups(batches, "bucket"):
            if table.num_rows < 2:
                continue
            ids = table.column("text_id").to_numpy()
            order = np.argsort(ids, kind="stable")
            keep = np.ones(len(ids), bool)
            keep[1:] = ids[order][1:] != ids[order][:-1]
            order = order[keep]
            if len(order) < 2:
                continue
            ids = ids[order]
            packed = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(-1, COORDINATES // 2)[order]
            sketch = np.concatenate([packed >> 4, packed & 15], axis=1)
            size = table.column("n").to_numpy()[order].astype(np.float64)
            a, b = [], []
            for k in range(0, len(ids) - 1):
                near = np.count_nonzero(sketch[k + 1 :] == sketch[k], axis=1) >= least * COORDINATES
                near &= np.minimum(size[k], size[k + 1 :]) >= threshold * np.maximum(size[k], size[k + 1 :])
                hit = np.flatnonzero(near) + k + 1
                a.append(np.full(len(hit), k))
                b.append(hit)
            a, b = np.concatenate(a), np.concatenate(b)
            if len(a):
                root = _roots(len(ids), a, b)
                leaf = np.flatnonzero(root != np.arange(len(ids)))
                yield pa.RecordBatch.from_arrays([pa.array(ids[leaf]), pa.array(ids[root[leaf]])], names=["a", "b"])

    return apply


def _near_first(least: float, threshold: float):
    """Edges of texts to the first of their bucket, where ``_likely`` would have them."""

    def sketches(col: pa.Array) -> np.ndarray:
        packed = np.frombuffer(b"".join(col.to_pylist()), np.uint8).reshape(-1, COORDINATES // 2)
        return np.concatenate([packed >> 4, packed & 15], axis=1)

    def apply(batches):
        for batch in batches:
            ids, n, sketch, first, first_n, first_sketch = batch.columns
            a, b = n.to_numpy().astype(np.float64), first_n.to_numpy().astype(np.float64)
            near = np.count_nonzero(sketches(sketch) == sketches(first_sketch), axis=1) >= least * COORDINATES
            near &= (np.minimum(a, b) >= threshold * np.maximum(a, b)) & (ids.to_numpy() != first.to_numpy())
            at = pa.array(np.flatnonzero(near))
            yield pa.RecordBatch.from_arrays([ids.take(at), first.take(at)], names=["a", "b"])

    return apply


def _against_all(rows: DataFrame, size: int) -> DataFrame:
    """Buckets of the few others of a large one with each block of its main group (rows with bucket, text_id, n, sketch, root, main, size)."""
    blocks = F.ceil(F.col("size") / size).cast("int")
    own = F.array(F.pmod(F.xxhash64("text_id"), blocks).cast("int"))
    block = F.explode(F.when(F.col("root") == F.col("main"), own).otherwise(F.sequence(F.lit(0), blocks - 1))).alias("block")
    return rows.select("bucket", "text_id", "n", "sketch", block).select(F.xxhash64("bucket", "block").alias("bucket"), "text_id", "n", "sketch")


# ---- components -------------------------------------------------------------------------------


def connected_components(edges: DataFrame, rounds: int = 64) -> DataFrame:
    """(node, root): the smallest node of each node's component, for edges (a, b) of integers, a > b or the reverse.

    Alternates large-star and small-star rounds; each is an aggregation and a join on edges, written to the shared folder."""
    stars = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    for _ in range(rounds):
        both = stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # tables on both sides of the joins let Spark split a hot one
        least = written(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least")
        large = written(both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct(), "edges")
        least = written(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        small = large.join(least, "a").select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("e"))
        new = written(small.select(F.col("e.b").alias("a"), F.col("e.m").alias("b")).where("a <> b").distinct(), "edges")
        # a forest of stars has no root that is itself a leaf
        if new.select("b").distinct().join(new.select(F.col("a").alias("b")).distinct(), "b", "left_semi").isEmpty():
            # each leaf must have one root
            if new.groupBy("a").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
                return new.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(new.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        stars = new
    raise RuntimeError(f"components did not settle in {rounds} rounds")


# ---- exact links ------------------------------------------------------------------------------


def _intersections(one: list[np.ndarray], other: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections, by matrix products over the shingles that both sides have."""
    a, b = np.concatenate(one), np.concatenate(other)
    common = np.intersect1d(a, b)
    out = np.zeros((len(one), len(other)), np.float32)
    where_a, where_b = np.searchsorted(common, a), np.searchsorted(common, b)
    row_a, row_b = np.repeat(np.arange(len(one)), [len(x) for x in one]), np.repeat(np.arange(len(other)), [len(x) for x in other])
    keep_a = (where_a < len(common)) & (common[np.minimum(where_a, len(common) - 1)] == a) if len(common) else np.zeros(len(a), bool)
    keep_b = (where_b < len(common)) & (common[np.minimum(where_b, len(common) - 1)] == b) if len(common) else np.zeros(len(b), bool)
    where_a, row_a, where_b, row_b = where_a[keep_a], row_a[keep_a], where_b[keep_b], row_b[keep_b]
    oa, ob = np.argsort(where_a, kind="stable"), np.argsort(where_b, kind="stable")
    where_a, row_a, where_b, row_b = where_a[oa], row_a[oa], where_b[ob], row_b[ob]
    width = 2048
    for k in range(0, len(common), width):
        s, e = np.searchsorted(where_a, [k, k + width])
        t, f = np.searchsorted(where_b, [k, k + width])
        x, y = np.zeros((len(one), width), np.float32), np.zeros((len(other), width), np.float32)
        x[row_a[s:e], where_a[s:e] - k] = 1
        y[row_b[t:f], where_b[t:f] - k] = 1
        out += x @ y.T
    return out


def _decide(threshold: float):
    """For each pair of blocks: (text_id, linked texts, linked documents, root) per text with an exact link."""

    def apply(batches):
        for _, table in groups(batches, "pair"):
            ids, copies = table.column("text_id").to_numpy(), table.column("copies").to_numpy()
            side = table.column("side").to_numpy()
            sets = [np.asarray(s, np.int64) for s in table.column("shingles").combine_chunks().to_numpy(zero_copy_only=False)]
            # within a block (side 2) both sides are the block
            left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
            if not len(left) or not len(right):
                continue
            size = np.array([len(s) for s in sets], np.float64)
            both = _intersections([sets[k] for k in left], [sets[k] for k in right]).astype(np.float64)
            total = size[left][:, None] + size[right][None, :] - both
            link = both >= threshold * total - 1e-6
            link &= left[:, None] != right[None, :]
            rows, cols = np.nonzero(link)
            a, b = left[rows], right[cols]
            texts, docs = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
            np.add.at(texts, a, 1)
            np.add.at(docs, a, copies[b])
            if side[0] != 2:
                np.add.at(texts, b, 1)
                np.add.at(docs, b, copies[a])
            order = np.argsort(ids, kind="stable")
            rank = np.empty(len(ids), np.int64)
            rank[order] = np.arange(len(ids))
            root = ids[order][_roots(len(ids), rank[a], rank[b])][rank]
            some = np.flatnonzero(texts)
            if len(some):
                yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(texts[some]), pa.array(docs[some]), pa.array(root[some])],
                                                 names=["text_id", "n_texts", "n_docs", "root"])

    return apply


def jaccard_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, recall: float = RECALL,
                    bucket: int = BUCKET, block: int = BLOCK) -> DataFrame:
    """(id, class_id, n_links, n_text_links, n_copies) per row.

    ``class_id``: smallest id of the connected component. ``n_links``: other documents at the threshold or
    more, copies counted. ``n_text_links``: different texts among them. ``n_copies``: rows with the same
    set, this one included. Ids must be of an integer type. Rows with a null id have a null class, no links
    and one copy, and are nobody's copy.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType
    if not isinstance(kind, IntegralType):
        raise TypeError(f"{id_col} must be of an integer type, and is {kind.simpleString()}")
    text_batches(spark, 256)
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null")
    described = written(rows.mapInArrow(_described, "id bigint, low bigint, high bigint, n int, mark array<int>"), "described")
    texts = written(described.where("n > 0").groupBy("low", "high").agg(F.min("id").alias("text_id"), F.count("*").alias("copies")), "texts")
    # One row of each text; texts themselves are not shuffled for this.
    marks = written(described.where("n > 0").withColumnRenamed("id", "text_id").join(texts.select("text_id"), "text_id", "left_semi")
                    .select("text_id", "n", "mark"), "marks")

    # Walked again where it is read again: that is cheaper than keeping some twenty rows a text.
    runs = runs_needed(recall, DEPTH, threshold)
    buckets = marks.mapInArrow(_walk(0, runs, DEPTH, threshold), _BUCKETS)
    agree = threshold + (1 - threshold) / 16  # four bits also agree by chance
    least = agree - 3 * math.sqrt(agree * (1 - agree) / COORDINATES)
    met, known, roots = None, [], None
    for depth in range(DEPTH, DEEPEST + 1):
        sizes = buckets.groupBy("bucket").agg(F.count("*").alias("size"), F.min("text_id").alias("first"))
        large = written(sizes.where(F.col("size") > bucket).select("bucket", "first"), "large")
        small = buckets.join(large, "bucket", "left_anti")
        met = small if met is None else met.unionByName(small)
        if large.isEmpty():
            break
        rest = written(buckets.join(large, "bucket"), "rest")
        if roots is None:
            pivots = rest.where("text_id = first").dropDuplicates(["bucket"]).select("bucket", F.col("n").alias("first_n"), F.col("sketch").alias("first_sketch"))
            known.append(written(rest.join(pivots, "bucket").select("text_id", "n", "sketch", "first", "first_n", "first_sketch").mapInArrow(_near_first(least, threshold), "a bigint, b bigint"), "pivots"))
            roots = written(connected_components(known[0]), "roots")
        placed = written(rest.join(roots, rest.text_id == roots.node, "left").select("bucket", "text_id", "n", "sketch", "first", F.coalesce("root", "text_id").alias("root")), "placed")
        per = placed.groupBy("bucket", "root").agg(F.count("*").alias("size")).groupBy("bucket").agg(F.sum("size").alias("size"), F.max(F.struct("size", "root")).alias("main"))
        mixed = written(per.select("bucket", "main.root", F.col("main.size").alias("size"), (F.col("size") - F.col("main.size")).alias("others")).where("others > 0"), "mixed")
        mine = placed.join(mixed.withColumnRenamed("root", "main"), "bucket")
        met = met.unionByName(_against_all(mine.where(F.col("others") <= bucket), bucket))
        rest = written(mine.where(F.col("others") > bucket).select("bucket", "text_id", "first"), "rest")
        if rest.isEmpty():
            break
        if depth == DEEPEST:
            # Alike in so many values that they count as likely; the exact comparison decides.
            known.append(rest.select(F.col("text_id").alias("a"), F.col("first").alias("b")).where("a <> b"))
        else:
            below = rest.join(marks, "text_id").select("bucket", "text_id", "n", "mark").mapInArrow(_split(threshold), _BUCKETS)
            if depth == DEPTH:
                # Their texts may go down to the deepest level, so they walk the runs that level requires.
                crowded = marks.join(rest.select("text_id").distinct(), "text_id", "left_semi")
                below = below.unionByName(crowded.mapInArrow(_walk(runs, runs_needed(recall, DEEPEST, threshold), DEPTH + 1, threshold), _BUCKETS))
            buckets = written(below, "buckets")
    likely = met.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_likely(least, threshold), "a bigint, b bigint")
    near = written(connected_components(reduce(DataFrame.unionByName, known, likely)), "near")

    # Members of a component are dealt out in blocks; every two blocks meet in one group.
    ranked = near.join(texts, near.node == texts.text_id).select("root", "text_id", "copies")
    sizes = ranked.groupBy("root").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    placed = ranked.join(sizes, "root").withColumn("block", F.pmod(F.xxhash64("text_id"), F.col("blocks")).cast("int"))
    members = placed.withColumnRenamed("text_id", "id")
    chosen = rows
    if near.count() <= MOST_IDS:
        # Few enough ids to send everywhere: then only the members' texts are shuffled, else all meet by id.
        chosen = rows.join(F.broadcast(near.select(F.col("node").alias("id"))), "id", "left_semi")
    sets = chosen.join(members, "id").select("id", "text", "root", "copies", "blocks", "block").mapInArrow(
        _set_rows, "text_id bigint, shingles array<bigint>, root bigint, copies bigint, blocks int, block int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    low, high = F.least("block", "other"), F.greatest("block", "other")
    side = F.when(F.col("block") == F.col("other"), 2).when(F.col("block") < F.col("other"), 0).otherwise(1)
    paired = sets.select("root", "text_id", "copies", "shingles", "block", other).select(
        F.xxhash64("root", low, high).alias("pair"), side.cast("int").alias("side"), "text_id", "copies", "shingles")
    links = written(
        paired.repartition("pair").sortWithinPartitions("pair", "text_id")
        .mapInArrow(_decide(threshold), "text_id bigint, n_texts bigint, n_docs bigint, root bigint"), "links")
    classes = connected_components(links.select(F.col("text_id").alias("a"), F.col("root").alias("b")))
    degree = links.groupBy("text_id").agg(F.sum("n_texts").alias("n_texts"), F.sum("n_docs").alias("n_docs"))
    known = written(
        texts.join(degree, "text_id", "left").join(classes.withColumnRenamed("node", "text_id"), "text_id", "left")
        .select("low", "high", "copies", F.coalesce("root", "text_id").alias("class_id"), F.coalesce("n_texts", F.lit(0)).alias("n_texts"), F.coalesce("n_docs", F.lit(0)).alias("n_docs")), "classes")
    copies = F.coalesce("copies", F.lit(1))
    out = described.join(known, ["low", "high"], "left").select(
        "id", F.coalesce("class_id", "id").alias("class_id"), (F.coalesce("n_docs", F.lit(0)) + copies - 1).alias("n_links"),
        F.coalesce("n_texts", F.lit(0)).alias("n_text_links"), copies.alias("n_copies"))
    none, number = F.lit(None).cast("bigint"), lambda n: F.lit(n).cast("bigint")
    nameless = docs.where(F.col(id_col).isNull()).select(none.alias("id"), none.alias("class_id"), number(0).alias("n_links"), number(0).alias("n_text_links"), number(1).alias("n_copies"))
    return out.unionByName(nameless).withColumn("id", F.col("id").cast(kind)).withColumnRenamed("id", id_col)


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class, links and copies of every document at a Jaccard similarity of 0.8 of five-word shingles."""
    return jaccard_classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
