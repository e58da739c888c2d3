"""Document fingerprints by context-triggered piecewise hashing.

A rolling hash over the last seven bytes cuts a text wherever its low bits are all ones, so a local
edit moves only the cuts near it. Each piece becomes one base-64 character; the fingerprint holds
the block size and the signatures at that and at twice that size. Two fingerprints are compared at
a common block size by weighted edit distance (insertions and deletions count 1, changes 2).

Null texts count as empty; the empty text's fingerprint is ``4::``. Equal texts have equal
fingerprints. Texts of any length are read in pieces of bounded size.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import strings, text_batches, written
from .tokens import CHUNK, mix, powers

WINDOW = 7
LEAST_BLOCK = 4
PIECES = 64  # block sizes aim at up to this many pieces
LONGEST = 128  # a signature's last character stands for all that is left
COMMON_RUN = 4  # signatures without a common run of this length are unlike
_CHARS = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)
_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _raised(base: np.uint64, exponents: np.ndarray) -> np.ndarray:
    """base ** exponents modulo 2**64."""
    out = np.ones(len(exponents), np.uint64)
    e = exponents.astype(np.uint64)
    while e.any():
        out = np.where(e & np.uint64(1), out * base, out)
        base = base * base
        e = e >> np.uint64(1)
    return out


def _cuts(data: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ends of pieces, the rolling hash there, and the prefix hash there; ``0`` and the text's end are added."""
    mask = np.uint64(block - 1)
    ends, marks, sums = [np.zeros(1, np.int64)], [np.zeros(1, np.uint64)], [np.zeros(1, np.uint64)]
    total, a, n = np.uint64(0), 0, len(data)
    up, down = powers(CHUNK + WINDOW)
    while a < n:
        b = min(n, a + CHUNK - WINDOW)
        lead = min(a, WINDOW - 1)
        piece = data[a - lead : b]
        local = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum(_VALUE[piece] * up[: len(piece)], out=local[1:])
        begin = np.maximum(np.arange(lead + 1, len(piece) + 1) - WINDOW, 0)
        roll = (local[lead + 1 :] - local[begin]) * down[begin]
        roll = (roll * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(24)
        at = np.flatnonzero((roll & mask) == mask)
        scale = np.uint64(1) if not a else _raised(up[1], np.array([a - lead]))[0]
        base = total - local[lead] * scale
        ends.append(at + a + 1)
        marks.append(roll[at])
        sums.append(base + local[at + lead + 1] * scale)
        total = base + local[-1] * scale
        a = b
    return np.concatenate([*ends, [n]]), np.concatenate([*marks, np.zeros(1, np.uint64)]), np.concatenate([*sums, [total]])


def _signature(ends: np.ndarray, sums: np.ndarray, longest: int) -> str:
    if ends[-1] == ends[-2]:
        ends, sums = ends[:-1], sums[:-1]
    if len(ends) - 1 > longest:
        ends, sums = np.append(ends[:longest], ends[-1]), np.append(sums[:longest], sums[-1])
    if len(ends) < 2:
        return ""
    up, down = powers(CHUNK)
    back = down[ends[:-1]] if ends[-2] < len(down) else _raised(down[1], ends[:-1])
    pieces = mix((sums[1:] - sums[:-1]) * back + np.diff(ends).astype(np.uint64))
    return _CHARS[(pieces >> np.uint64(58)).astype(np.int64)].tobytes().decode()


def fingerprint(text: str) -> str:
    """``block:signature:signature at twice the block``."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    block = LEAST_BLOCK
    while block * PIECES < len(data):
        block *= 2
    with np.errstate(over="ignore"):
        while True:
            ends, marks, sums = _cuts(data, block)
            if len(ends) - 1 >= PIECES // 4 or block == LEAST_BLOCK:
                break
            block //= 2
        mask = np.uint64(2 * block - 1)
        coarse = (marks & mask) == mask
        coarse[[0, -1]] = True
        return f"{block}:{_signature(ends, sums, LONGEST)}:{_signature(ends[coarse], sums[coarse], LONGEST // 2)}"


@lru_cache(1 << 12)
def _alike(a: str, b: str) -> float:
    """1 - distance / (sum of lengths), by the longest common subsequence in bit-parallel form."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    run = min(COMMON_RUN, max(1, min(len(a), len(b)) // 2))
    if {a[k : k + run] for k in range(len(a) - run + 1)}.isdisjoint(b[k : k + run] for k in range(len(b) - run + 1)):
        return 0.0
    places: dict[str, int] = {}
    for k, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << k
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & places.get(c, 0)
        row = (row + hit | row - hit) & full
    return 2 * (len(a) - row.bit_count()) / (len(a) + len(b))


def likeness(one: str, other: str) -> float:
    """0 to 1; 0 where the block sizes differ by more than a factor of two."""
    a, b = one.split(":"), other.split(":")
    x, y = int(a[0]), int(b[0])
    if x == y:
        return max(_alike(a[1], b[1]), _alike(a[2], b[2]) if a[2] and b[2] else 0.0)
    if x == 2 * y:
        return _alike(a[1], b[2])
    if y == 2 * x:
        return _alike(a[2], b[1])
    return 0.0


def edited(text: str, following: str) -> str:
    """The last quarter of ``text`` replaced by as many first code points of ``following``."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


_NAMES = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "text", "part"]
_COLUMNS = "n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compared(text: str, mark: str, following: str, next_mark: str) -> tuple:
    changed = edited(text, following)
    new = mark if changed == text else fingerprint(changed)
    return len(text), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), mark, new, likeness(mark, new), likeness(mark, next_mark)


def _neighbours(batches):
    """Compare each document of a sorted partition with the next one. The first text of the partition
    (part 1) and the last (part 2) go out whole, to be paired with those of the partitions beside it."""
    last = None
    kind = None
    for batch in batches:
        kind = batch.schema.field(0).type
        out = []
        for key, text in zip(batch.column(0).to_pylist(), strings(batch.column(1)).to_pylist()):
            mark = fingerprint(text)
            if last is None:
                out.append((key, len(text), None, mark, None, None, None, text, 1))
            else:
                out.append((last[0], *_compared(last[1], last[2], text, mark), None, 0))
            last = (key, text, mark)
        if out:
            yield _batch(out, kind)
    if last is not None:
        yield _batch([(last[0], len(last[1]), None, last[2], None, None, None, last[1], 2)], kind)


def _batch(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    kinds = [kind, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.string(), pa.int32()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=_NAMES)


def _pairs(batches):
    for batch in batches:
        rows = []
        for key, text, mark, following, next_mark in zip(*(c.to_pylist() for c in batch.columns)):
            rows.append((key, *_compared(text, mark, following, next_mark)))
        if rows:
            kinds = [batch.schema.field(0).type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=_NAMES[:7])


def fingerprints_with_neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) per row.

    The next document follows by ascending id (equal ids: by text); the last one's next is the first.
    Texts are shuffled once, by ranges of ids; a partition sends on two texts whole, and these are
    paired by a map of one row per partition.
    """
    spark = docs.sparkSession
    text_batches(spark, 256)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    made = written(
        rows.repartitionByRange("id").sortWithinPartitions("id", "text")
        .mapInArrow(_neighbours, f"id {kind}, {_COLUMNS}, text string, part int")
        .withColumn("task", F.spark_partition_id()), "fingerprints")
    inner = made.where("part = 0").select("id", *_NAMES[1:7])
    # One row per partition: which one's first text follows a partition's last.
    tasks = [r["task"] for r in made.where("part = 1").select("task", "id").orderBy(F.col("id").asc_nulls_first(), "task").collect()]
    if not tasks:
        return inner.withColumnRenamed("id", id_col)
    after = spark.createDataFrame([(t, tasks[(k + 1) % len(tasks)]) for k, t in enumerate(tasks)], "task int, follows int")
    ends = made.where("part = 2").select("task", "id", "text", "fingerprint").join(F.broadcast(after), "task")
    begins = made.where("part = 1").select(F.col("task").alias("follows"), F.col("text").alias("following"), F.col("fingerprint").alias("next_mark"))
    outer = (ends.join(begins, "follows").select("id", "text", "fingerprint", "following", "next_mark")
             .mapInArrow(_pairs, f"id {kind}, {_COLUMNS}"))
    return inner.unionByName(outer).withColumnRenamed("id", id_col)


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint of every document and of its edited text, and how like each other and the next one's they are."""
    return fingerprints_with_neighbours(spark.read.parquet(f"{sf_dir}/documents.parquet"))
