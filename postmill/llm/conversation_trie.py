"""The trie of conversations' turns, by splitters and their skeleton.

Conversations are sorted by their turns, first turn first, and then by id; ranges of that order are shards, which
splitters, conversations of a bounded sample, divide. A node of the trie is a sequence of first turns, and its members
stand side by side in the order. So a node that is no prefix of a splitter has all its members in one shard, and the
shard finishes it in one pass over its sorted rows, with a stack of open nodes. The prefixes of splitters are the
skeleton: it is broadcast, shards only add up what they have of its nodes (members, smallest id, children and sums
below that aren't in the skeleton), and these partial aggregates are combined by a reduction. As ids are part of the
order, conversations that are all equal are divided among shards as well.

The skeleton has at most ``MOST_NODES`` nodes whatever the input, so it is worked out from the leaves up in the driver.
The ids that end at a skeleton node may come from many shards: shards send them as joined strings, in pieces, and a digest
is taken of one piece after the other.

A turn travels as 20 bytes, 16 of its digest and 4 of its text's length, and all turns of one conversation meet in one row.
Conversations without turns are members of the root; null ids are no conversations and are left out; a null role or text is
empty; turns of equal number (null first) come by role, then by digest. Ids are integers. Repeated rows are turns of their
own. Of no conversations there is no trie, not even a root.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right

import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import groups, text_batches, written

#: Bytes of a turn in a path: of its digest, and of its text's length.
DIGEST, STEP = 16, 20
#: Conversations of a shard, about, until there are ``MOST_SHARDS``; of so many for each shard splitters are taken.
SHARD, MOST_SHARDS, SAMPLED = 1 << 16, 1 << 13, 8
#: Nodes of the skeleton at most; splitters are cut to as many turns as fit.
MOST_NODES = 1 << 18
#: Ids of a piece.
PIECE = 1 << 15
_ROWS = 4096


def turn_step(role: str = "role", text: str = "text"):
    """The 20 bytes of a turn, in hexadecimal, which keeps their order."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text))
    digest = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)
    return F.concat(F.substring(digest, 1, 2 * DIGEST), F.lpad(F.hex(F.octet_length(text)), 8, "0"))


def _turns(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by, steps) of rows (conv_id, turn, role, step)."""
    ordered = F.sort_array(F.collect_list(F.struct("turn", "role", "step")))
    return rows.groupBy(*by).agg(F.transform(ordered, lambda t: t["step"]).alias("steps"))


def _steps(turns: DataFrame) -> DataFrame:
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    return turns.where("conv_id is not null").select(F.col("conv_id").cast("bigint").alias("conv_id"), "turn", role.alias("role"), turn_step().alias("step"))


def _path(steps) -> object:
    return F.unhex(F.array_join(steps, "")).alias("path")


def paths(turns: DataFrame) -> DataFrame:
    """(conv_id, path) of turns (conv_id, turn, role, text) as they stand."""
    return _turns(_steps(turns), ["conv_id"]).select("conv_id", _path(F.col("steps")))


def paths_with_shared_heads(turns: DataFrame, family: int = 5, heads: int = 9) -> DataFrame:
    """(conv_id, path) of rebuilt conversations: the first h turns of conversation ``conv_id - conv_id % family``, all if it has fewer, then
    its own after its first h; h is the CRC-32 of the decimal id modulo ``heads``. One shuffle, by family."""
    rows = _steps(turns).withColumn("base", F.col("conv_id") - F.col("conv_id") % family)
    own = _turns(rows.repartition("base"), ["base", "conv_id"])
    of = own.select("conv_id", "steps", F.expr("max(CASE WHEN conv_id = base THEN steps END) OVER (PARTITION BY base)").alias("given"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("int")
    head = F.slice(F.coalesce("given", F.array().cast("array<string>")), F.lit(1), h)
    return of.select("conv_id", _path(F.concat(head, F.slice("steps", h + 1, F.size("steps")))))


def _splitters(made: DataFrame, shards: int, n: int) -> list[tuple[bytes, int]]:
    """At most ``shards - 1`` places (path, conv_id) that divide the sorted conversations into about equal shards."""
    if shards < 2:
        return []
    of = 1 << 30
    taken = made.where(F.pmod(F.xxhash64("conv_id"), F.lit(of)) < min(of, of * SAMPLED * shards // n))
    depth = max(1, MOST_NODES // shards)
    rows = taken.select(F.substring("path", 1, STEP * depth).alias("path"), "conv_id").toArrow()
    sample = sorted(set(zip(rows["path"].to_pylist(), rows["conv_id"].to_pylist())))
    return sorted({sample[len(sample) * k // shards] for k in range(1, shards)}) if sample else []


def _skeleton(splitters: list[tuple[bytes, int]]) -> dict[bytes, int]:
    """Every prefix of a splitter's path, by number; parents come before their children, the root first."""
    there = {b""} | {path[:end] for path, _ in splitters for end in range(STEP, len(path) + 1, STEP)}
    return {path: k for k, path in enumerate(sorted(there, key=lambda p: (len(p), p)))}


def _shard(splitters: Broadcast):
    def apply(batches):
        cuts = splitters.value
        for batch in batches:
            shard = [bisect_right(cuts, row) for row in zip(batch.column(1).to_pylist(), batch.column(0).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shard, pa.int32())], names=["conv_id", "path", "shard"])

    return apply


_NODE, _PART, _ENDS = 0, 1, 2
_COLUMNS = "kind int, skeleton int, conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends string"
_KINDS = [pa.int32(), pa.int32(), *[pa.int64()] * 7, pa.string()]
_NAMES = [c.split()[0] for c in _COLUMNS.split(", ")]


class _Node:
    """An open node: what has been seen below it so far."""

    __slots__ = ("bytes", "skeleton", "least", "convs", "children", "leaves", "saved", "digest", "ends", "held")

    def __init__(self, size: int, skeleton: int | None):
        self.bytes, self.skeleton = size, skeleton
        self.least = None
        self.convs = self.children = self.leaves = self.saved = 0
        self.digest = None  # of ids that end here; a skeleton node keeps them in ``ends`` instead, to be sent
        self.ends: list[int] = []
        self.held: list[tuple] = []  # finished children, until this node's smallest id is known

    def ends_with(self, conv: int) -> None:
        self.convs += 1
        self.least = conv if self.least is None else min(self.least, conv)
        if self.skeleton is not None:
            self.ends.append(conv)
        elif self.digest is None:
            self.digest = hashlib.sha256(str(conv).encode())
        else:
            self.digest.update(b",%d" % conv)


_NO_ENDS = hashlib.sha256().hexdigest()


def _tries(skeleton: Broadcast):
    """Finished nodes, partial aggregates of skeleton nodes and pieces of their ends, of rows (conv_id, path) in order."""

    def apply(batches):
        known = skeleton.value
        stack, before, out = [_Node(0, known[b""])], b"", []
        any_row = False

        def pieces(node: _Node) -> None:
            if node.ends:
                out.append((_ENDS, node.skeleton, node.ends[0], *[None] * 6, ",".join(map(str, node.ends))))
                node.ends = []

        def close() -> None:
            node, depth = stack.pop(), len(stack)
            above = stack[-1] if stack else None
            if node.skeleton is not None:
                pieces(node)
                out.append((_PART, node.skeleton, node.least, depth, None, node.convs, node.children, node.leaves, node.saved, None))
            else:
                node.leaves = node.leaves or 1
                node.saved += (node.convs - 1) * node.bytes
                for kid in node.held:
                    out.append((_NODE, None, *kid[:2], node.least, *kid[2:]))
                row = (node.least, depth, node.convs, node.children, node.leaves, node.saved, node.digest.hexdigest() if node.digest else _NO_ENDS)
                if above.skeleton is None:
                    above.held.append(row)
                else:
                    out.append((_NODE, above.skeleton, *row[:2], None, *row[2:]))
                above.children += 1
            if above:
                above.convs += node.convs
                if node.skeleton is None:  # the skeleton's own sums are carried up at the end
                    above.leaves += node.leaves
                    above.saved += node.saved
                above.least = node.least if above.least is None else min(above.least, node.least)

        def ready():
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _KINDS)], names=_NAMES)
            out.clear()
            return batch

        for batch in batches:
            for conv, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                any_row = True
                same, end = 0, min(len(path), len(before))
                while same < end and path[same : same + STEP] == before[same : same + STEP]:
                    same += STEP
                while len(stack) > same // STEP + 1:
                    close()
                for at in range(same, len(path), STEP):
                    # below a node that isn't in the skeleton, none is
                    of = known.get(path[: at + STEP]) if stack[-1].skeleton is not None else None
                    stack.append(_Node(int.from_bytes(path[at + DIGEST : at + STEP], "big"), of))
                stack[-1].ends_with(conv)
                if len(stack[-1].ends) >= PIECE:
                    pieces(stack[-1])
                before = path
                if len(out) >= _ROWS:
                    yield ready()
        if any_row:
            while stack:
                close()
            yield ready()

    return apply


def _digests(batches):
    """(skeleton, ends): the digest of each skeleton node's pieces, which come in order."""
    now, digest = None, None

    def row():
        return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([digest.hexdigest()])], names=["skeleton", "ends"])

    for batch in batches:
        for of, piece in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if of != now:
                if now is not None:
                    yield row()
                now, digest = of, hashlib.sha256(piece.encode())
            else:
                digest.update(b"," + piece.encode())
    if now is not None:
        yield row()


def _finished(skeleton: dict[bytes, int], parts: pa.Table) -> pa.Table:
    """Skeleton nodes from the partial sums of each: what is in the skeleton itself is added from the leaves up."""
    paths_ = list(skeleton)
    n = len(paths_)
    cols = {c: [0] * n for c in ("conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")}
    for row in parts.to_pylist():
        for c in cols:
            cols[c][row["skeleton"]] = row[c]
    above = [skeleton[p[:-STEP]] if p else None for p in paths_]
    for k in range(n - 1, -1, -1):  # children first
        cols["saved_tokens"][k] += (cols["n_convs"][k] - 1) * int.from_bytes(paths_[k][-4:], "big") if paths_[k] else 0
        cols["n_leaves"][k] = cols["n_leaves"][k] or 1
        if above[k] is not None:
            cols["n_children"][above[k]] += 1
            cols["n_leaves"][above[k]] += cols["n_leaves"][k]
            cols["saved_tokens"][above[k]] += cols["saved_tokens"][k]
    table = {"skeleton": range(n), "conv_id": cols["conv_id"], "depth": [len(p) // STEP for p in paths_], "parent_conv_id": [None if a is None else cols["conv_id"][a] for a in above]}
    return pa.table({c: pa.array(v, pa.int32() if c == "skeleton" else pa.int64()) for c, v in {**table, **{c: cols[c] for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")}}.items()})


def prefix_trie(conversations: DataFrame, shard: int = SHARD) -> DataFrame:
    """One row per node of conversations (conv_id, path), each id once: conv_id (the smallest member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens and ends_sha256."""
    spark = conversations.sparkSession
    sc = spark.sparkContext
    text_batches(spark, 4096)
    made = written(conversations.select("conv_id", "path"), "paths")
    n = made.count()
    shards = max(1, min(max(n // shard, int(spark.conf.get("spark.sql.shuffle.partitions"))), MOST_SHARDS, n))
    splitters = _splitters(made, shards, max(n, 1))
    skeleton = _skeleton(splitters)
    found = written(
        made.mapInArrow(_shard(sc.broadcast(splitters)), "conv_id bigint, path binary, shard int").repartitionById(shards, "shard")
        .sortWithinPartitions("shard", "path", "conv_id").select("conv_id", "path").mapInArrow(_tries(sc.broadcast(skeleton)), _COLUMNS), "trie")
    sums = ("n_convs", "n_children", "n_leaves", "saved_tokens")
    parts = found.where(F.col("kind") == _PART).groupBy("skeleton").agg(F.min("conv_id").alias("conv_id"), *(F.sum(c).alias(c) for c in sums)).toArrow()
    inner = spark.createDataFrame(_finished(skeleton, parts)).where("n_convs > 0")
    ends = (found.where(F.col("kind") == _ENDS).select("skeleton", "ends", "conv_id").repartition("skeleton").sortWithinPartitions("skeleton", "conv_id")
            .select("skeleton", "ends").mapInArrow(_digests, "skeleton int, ends string"))
    names = ["conv_id", "depth", "parent_conv_id", *sums, "ends_sha256"]
    top = inner.join(ends, "skeleton", "left").withColumn("ends_sha256", F.coalesce("ends", F.lit(_NO_ENDS))).select(*names)
    above = F.broadcast(inner.select("skeleton", F.col("conv_id").alias("above")))  # MOST_NODES rows at most
    rest = (found.where(F.col("kind") == _NODE).join(above, "skeleton", "left")
            .withColumns({"parent_conv_id": F.coalesce("parent_conv_id", "above"), "ends_sha256": F.col("ends")}).select(*names))
    return top.unionByName(rest)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all rebuilt conversations."""
    return prefix_trie(paths_with_shared_heads(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


#: CRC-32 bit by bit: eight entries for each byte, the byte and seven zeros.
_CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda x: [ord(x)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))), lambda a, x: xor(xor(a, x) >> 1, 3988292384 * (xor(a, x) & 1))), 4294967295)"

OP13_SQL = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
s AS (SELECT conv_id, turn, role, struct_pack(k := sha256(strlen(role)::VARCHAR || ':' || role || text), b := strlen(text)) AS e FROM t),
c AS (SELECT conv_id, list(e ORDER BY turn NULLS FIRST, role, e.k) AS w FROM s GROUP BY conv_id),
h AS (SELECT conv_id, w, CAST({_CRC} % 9 AS BIGINT) AS h FROM c),
r AS (SELECT a.conv_id, CASE WHEN b.w IS NULL THEN a.w[a.h + 1 :] ELSE list_concat(b.w[1 : a.h], a.w[a.h + 1 :]) END AS w FROM h AS a LEFT JOIN c AS b ON b.conv_id = a.conv_id - a.conv_id % 5),
m AS (SELECT conv_id, len(w) = d AS last, d, w[1 : d] AS path FROM (SELECT conv_id, w, unnest(range(0, len(w) + 1)) AS d FROM r)),
n AS (SELECT path, d, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(string_agg(CASE WHEN last THEN conv_id::VARCHAR END, ',' ORDER BY conv_id), '') AS ends, CASE WHEN d = 0 THEN 0 ELSE path[d].b END AS b FROM m GROUP BY path, d),
k AS (SELECT path[1 : d - 1] AS path, count(*) AS n_children FROM n WHERE d > 0 GROUP BY 1),
f AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k USING (path)),
u AS (SELECT path[1 : i] AS path, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((n_convs - 1) * b) AS saved_tokens FROM (SELECT *, unnest(range(0, d + 1)) AS i FROM f) GROUP BY 1)
SELECT f.conv_id, f.d AS depth, CASE WHEN f.d > 0 THEN p.conv_id END AS parent_conv_id, f.n_convs, f.n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(f.ends) AS ends_sha256
FROM f JOIN u USING (path) LEFT JOIN n AS p ON p.path = f.path[1 : f.d - 1] AND p.d = f.d - 1
"""
