"""Repeated passages of a corpus by prefix-partitioned suffix trees.

A suffix begins at every word that has a whole window of words after it in its document. Suffixes are
dealt out to groups by a prefix of their words, whose length varies: four words, or 8, 16, 32 where more
suffixes begin like that than a group should hold, and the window itself where even that doesn't
divide them. So a group fits into a worker's memory, and holds whole subtrees of the corpus's suffix tree:
suffixes that share a window share all its prefixes. A first pass counts prefixes to find the lengths.

Within a group the suffixes are sorted by their path down to the depth of a window, which puts the
leaves of each node of that depth side by side. A node with two leaves or more is a repeat; what
lies below it can't change which words are repeated, so trees end there. Starts that follow one another
in a text are joined to its maximal repeated passages.

A suffix travels as a 64-bit hash of its path and its place, about ten bytes: words aren't copied into the
groups. The group depends on another hash, of the prefix; only suffixes that agree in both are taken for
equal. Tasks build trees of their own first, over chunks of about two million words, and send each
different window once, so a passage that a third of all texts have reaches its group once a chunk.

Texts are known by their digest, so equal texts are answered alike, under whatever id. Null texts count as
empty; a text of fewer words than a window has no repeats. Repeated rows are different documents: each
one's windows start elsewhere, too. An empty table gives an empty result. The documents are read twice and
must be the same each time, as a table is.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import groups, text_batches, written
from .tokens import _BASE, EXACT, hash_words, mix

#: Words in a row that make a repeat.
WINDOW = 35
#: Lengths of prefixes that divide suffixes into groups; after the last that is shorter than a window comes the window itself.
PREFIXES = (4, 8, 16, 32)
#: Windows of one task's tree, and those whose hashes are worked out in one go.
CHUNK, SLICE = 1 << 21, 1 << 18
#: Suffixes of a group, about, up to ``MOST_GROUPS`` of them; beyond that groups grow.
GROUP, MOST_GROUPS = 1 << 18, 1 << 18
#: A prefix of more suffixes than this, and than a share of 1/MOST_GROUPS of all, is made longer: at most MOST_GROUPS of a length are broadcast.
MOST_OF_PREFIX = 1 << 15


def _power(n: int) -> np.uint64:
    return np.uint64(pow(int(_BASE), n, 1 << 64))


def _paths(words: np.ndarray, window: int) -> dict[int, np.ndarray]:
    """Hashes of the next 1, 2, 4, ... and ``window`` words from each word that has as many."""
    out, size = {1: words}, 1
    with np.errstate(over="ignore"):
        while 2 * size <= window:
            out[2 * size] = out[size][:-size] * _power(size) + out[size][size:]
            size *= 2
        whole, done = out[size], size
        while done < window:
            size = 1 << ((window - done).bit_length() - 1)
            whole = whole[: len(words) - done - size + 1] * _power(size) + out[size][done : done + len(words) - done - size + 1]
            done += size
    return {**out, window: whole}


def _prefixes(window: int) -> list[int]:
    return [p for p in PREFIXES if p < window]


def _chunks(batches, window: int, size: int, kept):
    """Yield (pieces, arrays) for up to ``size`` windows of Arrow batches (key, text). A piece is a text's key, the word it begins with and
    its windows; ``kept`` makes of the hashes of some windows, by length, the arrays that are held for each. They are used again after a chunk."""
    held, pieces, n = [], [], 0
    for batch in batches:
        words, rows = hash_words(batch.column(1), EXACT)
        counts = np.maximum(np.diff(rows) - window + 1, 0)
        ends = np.cumsum(counts)
        begins, a = ends - counts, 0
        while len(ends) and a < ends[-1]:
            b = int(min(ends[-1], a + size - n, a + SLICE))
            some = np.arange(np.searchsorted(ends, a, "right"), np.searchsorted(begins, b))
            some = some[counts[some] > 0]
            first, last = np.maximum(begins[some], a), np.minimum(ends[some], b)
            at = np.repeat(rows[some] - begins[some], last - first) + np.arange(a, b)
            found = _paths(words[at[0] : at[-1] + window], window)
            at -= at[0]
            made = kept({p: h[at] for p, h in found.items() if p == window or p in PREFIXES}, window)
            held = held or [np.empty(size, m.dtype) for m in made]
            for whole, m in zip(held, made):
                whole[n : n + b - a] = m
            keys = batch.column(0).take(pa.array(some)).to_pylist()
            pieces += zip(keys, (first - begins[some]).tolist(), (last - first).tolist())
            n += b - a
            a = b
            if n >= size:
                yield pieces, [h[:n] for h in held]
                pieces, n = [], 0
    if n:
        yield pieces, [h[:n] for h in held]


def _runs(paths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by path, where in it each node begins, and how many leaves each node has."""
    order = np.argsort(paths)
    inside = paths[order]
    begins = np.flatnonzero(np.concatenate([[True], inside[1:] != inside[:-1]]))
    return order, begins, np.diff(np.append(begins, len(paths)))


def _count_prefixes(window: int, size: int, share: int):
    """(length, prefix, n): prefixes that at least a ``share``-th part of a chunk's different windows have; length 0 counts all."""

    def kept(hashes, window):
        return [hashes[window], *(hashes[p] for p in _prefixes(window))]

    def apply(batches):
        for _, (paths, *prefixes) in _chunks(batches, window, size, kept):
            order, begins, _ = _runs(paths)
            left = order[begins]
            del order
            out = [(0, np.zeros(1, np.uint64), np.array([len(begins)]))]
            least = max(2, len(begins) // share)
            for length, values in zip(_prefixes(window), prefixes):
                found, n = np.unique(values[left], return_counts=True)
                found, n = found[n >= least], n[n >= least]
                out.append((length, found, n))
                left = left[np.isin(values[left], found)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat([o[0] for o in out], [len(o[1]) for o in out]), pa.int32()), pa.array(np.concatenate([o[1] for o in out]).view(np.int64)),
                 pa.array(np.concatenate([o[2] for o in out]), pa.int64())], names=["length", "prefix", "n"])

    return apply


def _grouped(large: dict[int, np.ndarray], n_groups: int):
    """Path and group of each suffix: the group is that of its shortest prefix that isn't too common, or of its whole window."""

    def kept(hashes, window):
        paths = mix(hashes[window])
        by, left = paths.copy(), np.arange(len(paths))
        for length in _prefixes(window):
            prefixes = hashes[length][left]
            common = np.isin(prefixes, large[length])
            by[left[~common]] = prefixes[~common] + np.uint64(length)
            left = left[common]
        return paths, (mix(by) % np.uint64(n_groups)).astype(np.int32)

    return kept


def _planes(values: np.ndarray) -> bytes:
    """uint32 byte by byte, so that high bytes, nearly all zero, stand together and compress."""
    return values.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _values(data: memoryview | bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, np.uint8, 4 * n).reshape(4, n).T.copy().view("<u4").ravel().astype(np.int64)


_DIRECTORY, _KNOWN, _SUFFIXES = 0, 1, 2
_ROWS = "group bigint, chunk bigint, kind int, data binary"


def _directory(pieces: list[tuple[bytes, int, int]]) -> bytes:
    table = pa.table([pa.array([p[0] for p in pieces], pa.binary()), pa.array([p[1] for p in pieces], pa.int64()), pa.array([p[2] for p in pieces], pa.int64())], names=["key", "first", "n"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["group", "chunk", "kind", "data"])


def _suffixes(window: int, size: int, large: Broadcast, n_groups: int):
    """A chunk's own repeats, and for each group what it sends there: one suffix of each different window, with its place."""

    def apply(batches):
        for pieces, (paths, group) in _chunks(batches, window, size, _grouped(large.value, n_groups)):
            order, begins, leaves = _runs(paths)
            first = np.minimum.reduceat(order, begins)
            known = np.zeros(len(paths), bool)
            known[order] = np.repeat(leaves > 1, leaves)
            directory = _directory(pieces)
            chunk = int.from_bytes(hashlib.blake2b(directory, digest_size=8).digest(), "little", signed=True)
            out = [(chunk % n_groups, chunk, _DIRECTORY, directory), (chunk % n_groups, chunk, _KNOWN, np.packbits(known).tobytes())]
            by = np.sort(group[first].astype(np.int64) << 32 | first)
            group, first = by >> 32, by & 0xFFFFFFFF
            sent, asks = paths[first], known[first]
            cuts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1], [True]]))
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                steps = np.diff(first[a:b], prepend=0) * 2 + asks[a:b]
                out.append((int(group[a]), chunk, _SUFFIXES, _planes(steps) + sent[a:b].tobytes()))
            yield _batch(out)

    return apply


def _subtrees(batches):
    """The deep nodes of each group: to every chunk go the places of its windows that stand in another one, too."""
    for group, table in groups(batches, "group"):
        rows = list(zip(*(table.column(c).to_pylist() for c in ("chunk", "kind", "data"))))
        out = [(group, *r) for r in rows if r[1] != _SUFFIXES]
        rows = [(c, d, len(d) // 12) for c, k, d in rows if k == _SUFFIXES]
        if rows:
            paths = np.concatenate([np.frombuffer(d, np.uint64, n, 4 * n) for _, d, n in rows])
            order, _, leaves = _runs(paths)
            repeated = np.empty(len(paths), bool)
            repeated[order] = np.repeat(leaves > 1, leaves)
            at = 0
            for chunk, data, n in rows:
                steps = _values(data, n)
                places = np.cumsum(steps >> 1)[repeated[at : at + n] & (steps & 1 == 0)]
                at += n
                if len(places):
                    out.append((group, chunk, _SUFFIXES, _planes(np.diff(places, prepend=0))))
        if out:
            yield _batch(out)


def _passages(window: int):
    """(key, spans): for each text of a chunk with repeats, the first and end word of its passages, one after the other."""

    def apply(batches):
        for _, table in groups(batches, "chunk"):
            known, places, pieces = None, [], None
            for kind, data in zip(table.column("kind").to_pylist(), table.column("data").to_pylist()):
                if kind == _DIRECTORY:
                    pieces = pa.ipc.open_stream(data).read_all()
                elif kind == _KNOWN:
                    known = data
                else:
                    places.append(np.cumsum(_values(data, len(data) // 4)))
            counts, firsts = pieces["n"].to_numpy(), pieces["first"].to_numpy()
            begins = np.cumsum(counts) - counts
            marked = np.unpackbits(np.frombuffer(known, np.uint8), count=int(counts.sum())).view(bool).copy()
            for p in places:
                marked[p] = True
            at = np.flatnonzero(marked)
            if not len(at):
                continue
            piece = np.searchsorted(begins, at, "right") - 1
            word = at - begins[piece] + firsts[piece]
            new = np.flatnonzero(np.concatenate([[True], (piece[1:] != piece[:-1]) | (word[1:] > word[:-1] + window)]))
            last = np.append(new[1:], len(at)) - 1
            spans = np.stack([word[new], word[last] + window], 1).ravel()
            of = piece[new]
            cuts = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1], [True]]))
            keys = pieces["key"].take(pa.array(of[cuts[:-1]])).to_pylist()
            found = {(k, tuple(spans[2 * a : 2 * b].tolist())) for k, a, b in zip(keys, cuts[:-1].tolist(), cuts[1:].tolist())}
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.binary()), pa.array([list(s) for _, s in found], pa.list_(pa.int64()))], names=["key", "spans"])

    return apply


def _key(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def _text(col: str) -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def repeated_passages(docs: DataFrame, text_col: str = "text", window: int = WINDOW, chunk: int = CHUNK, most: int = MOST_OF_PREFIX) -> DataFrame:
    """(key, spans): for each different text that has any, by its SHA-256, the word numbers [first, end, first, end, ...] of passages
    whose windows all stand elsewhere, too. Spans may overlap where a text was cut between chunks. Stored in the shared folder."""
    spark = docs.sparkSession
    text_batches(spark)
    sc = spark.sparkContext
    rows = docs.select(_text(text_col).alias("text")).select(_key(F.col("text")).alias("key"), "text")
    counts = written(rows.mapInArrow(_count_prefixes(window, chunk, MOST_GROUPS), "length int, prefix bigint, n bigint")
                     .groupBy("length", "prefix").agg(F.sum("n").alias("n")), "prefixes")
    n = (counts.where("length = 0").agg(F.sum("n")).first()[0] or 0)
    # a length has n suffixes at most, and so at most MOST_GROUPS prefixes that are more common than this
    common = counts.where((F.col("length") > 0) & (F.col("n") > max(most, n // MOST_GROUPS))).select("length", "prefix").toArrow()
    lengths, prefixes = common["length"].to_numpy(), common["prefix"].to_numpy().view(np.uint64)
    large = sc.broadcast({p: np.sort(prefixes[lengths == p]) for p in _prefixes(window)})
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n // (8 * GROUP))
    n_groups = max(4 * tasks, min(n // GROUP, MOST_GROUPS))
    return written(
        rows.mapInArrow(_suffixes(window, chunk, large, n_groups), _ROWS)
        .repartition(tasks, "group").sortWithinPartitions("group").mapInArrow(_subtrees, _ROWS)
        .repartition(tasks, "chunk").sortWithinPartitions("chunk").mapInArrow(_passages(window), "key binary, spans array<bigint>")
        .groupBy("key").agg(F.flatten(F.collect_set("spans")).alias("spans")), "passages")


def _without(words: list[bytes], spans: list[int] | None) -> list[bytes]:
    if not spans:
        return words
    kept, at = [], 0
    for a, b in sorted(zip(spans[::2], spans[1::2])):
        if a > at:
            kept += words[at:a]
        at = max(at, b)
    return kept + words[at:]


def _kept(batches):
    for batch in batches:
        out = []
        for text, spans in zip(batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist()):
            words = text.split()  # of bytes: by space and \t \n \v \f \r, by nothing else
            kept = _without(words, spans)
            out.append((len(words), len(words) - len(kept), b" ".join(kept)))
        n, gone, kept = zip(*out) if out else ((), (), ())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=["id", "n_words", "n_removed", "kept"])


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, chunk: int = CHUNK, most: int = MOST_OF_PREFIX) -> DataFrame:
    """(id, n_words, n_removed, kept) per row: the words that no repeated window covers, joined by one space."""
    found = repeated_passages(docs, text_col, window, chunk, most)
    rows = docs.select(F.col(id_col).alias("id"), _text(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return (rows.withColumn("key", _key(F.col("text"))).join(found, "key", "left").select("id", "text", "spans")
            .mapInArrow(_kept, f"id {kind}, n_words bigint, n_removed bigint, kept string").withColumnRenamed("id", id_col))


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document, how many of them repeated passages cover, and the digest of what is kept."""
    found = without_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


OP11_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT r, p, md5(array_to_string(w[p + 1 : p + {WINDOW}], ' ')) AS g FROM (SELECT r, w, unnest(range(0, len(w) - {WINDOW} + 1)) AS p FROM d)),
m AS (SELECT r, p FROM s WHERE g IN (SELECT g FROM s GROUP BY g HAVING count(*) > 1)),
x AS (SELECT d.r, q, word, max(m.p) OVER (PARTITION BY d.r ORDER BY q ROWS UNBOUNDED PRECEDING) AS before
      FROM (SELECT r, unnest(w) AS word, unnest(range(0, len(w))) AS q FROM d) AS d LEFT JOIN m ON m.r = d.r AND m.p = q),
k AS (SELECT r, count(*) AS n, string_agg(word, ' ' ORDER BY q) AS kept FROM x WHERE before IS NULL OR q >= before + {WINDOW} GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (r)
"""
