"""Tables in a shared folder that change together, version by version.

A version writes new files for what it changes and then one small list, which says for every table which files hold
it; the list comes last, so all tables of a version count or none does. Nothing is kept outside of the folder: a new
object over it goes on where the last one ended, and a batch that comes again finds its version done, or does
what was left unfinished anew.

Keyed tables are in parts, ranges of a hash of the key. A version rewrites the parts that it has keys of; one that
would outgrow ``rows`` is then written as 2, 4, 8, ... parts, so that parts, and the tasks that write them, stay of one size however large the
table grows. Tables without a key only grow: each version adds a segment, and small segments are merged now and then.
The lists have some 100 bytes a part, and are read by the driver: 10^10 rows in parts of a million are 10^4 entries.

One writer at a time. Readers take the last version, or an earlier one until ``vacuum`` has removed it.
"""

from __future__ import annotations

import bisect
import json
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Keys are hashed to so many bits; parts are ranges of them.
BITS = 31
#: Segments of a table without a key, beyond which the small ones are merged.
MOST_SEGMENTS = 16


@dataclass(frozen=True)
class Table:
    """A keyed table, or one that only grows where there is no key; ``parts``, a power of two, is where it begins."""

    schema: T.StructType
    key: tuple[str, ...] = ()
    parts: int = 1
    rows: int = 1 << 20


@dataclass(frozen=True)
class Part:
    """Hash values from ``start`` to before ``end`` (of a segment: its number), and where its rows are: nowhere, if there are none."""

    start: int
    end: int
    version: int
    rows: int = 0
    path: str | None = None


@dataclass
class Version:
    """What is written so far of a version; it counts once ``Store.commit`` has listed it."""

    number: int
    parts: dict[str, list[Part]] = field(default_factory=dict)


def _hash(key: tuple[str, ...]) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*key), 64 - BITS)


def _start_of(value: Column, parts: list[Part]) -> Column:
    """The start of the part that has a hash value: by a directory with an entry for each range of the smallest part's size."""
    size = min(p.end - p.start for p in parts)
    if size == 1 << BITS:
        return F.lit(0).cast("bigint")
    starts = [p.start for p in parts]
    slots = [starts[bisect.bisect_right(starts, at) - 1] for at in range(0, 1 << BITS, size)]
    directory = F.from_json(F.lit(json.dumps(slots)), "array<bigint>")
    return F.element_at(directory, (F.shiftright(value, size.bit_length() - 1) + 1).cast("int"))


def _split(part: Part, rows: int, most: int) -> list[Part]:
    """The part as as many equal ones as ``rows`` rows need."""
    n, size = 1, part.end - part.start
    while rows > n * most and size // n > 1:
        n *= 2
    return [Part(part.start + k * (size // n), part.start + (k + 1) * (size // n), part.version) for k in range(n)]


class Store:
    def __init__(self, spark: SparkSession, folder: str, tables: dict[str, Table]):
        self.spark, self.folder, self.tables = spark, folder.rstrip("/"), tables
        self._root = self._path("")
        self._files = self._root.getFileSystem(spark._jsc.hadoopConfiguration())

    # ---- files ----

    def _path(self, relative: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{relative}" if relative else self.folder)

    def _names(self, relative: str) -> list[str]:
        path = self._path(relative)
        return [s.getPath().getName() for s in self._files.listStatus(path)] if self._files.exists(path) else []

    def _write_list(self, number: int, parts: dict[str, list[Part]]) -> None:
        """Under another name first: a list is there whole or not at all."""
        temporary, final = self._path(f"lists/_{number}.json"), self._path(f"lists/{number}.json")
        out = self._files.create(temporary, True)
        out.write(bytearray(json.dumps({name: [asdict(p) for p in ps] for name, ps in parts.items()}).encode()))
        out.close()
        if not self._files.rename(temporary, final):
            raise OSError(f"{final} could not be written")

    # ---- reading ----

    def versions(self) -> list[int]:
        """Numbers of the complete versions that are still there, in order."""
        return sorted(int(n[:-5]) for n in self._names("lists") if n.endswith(".json") and not n.startswith("_"))

    def parts(self, table: str, version: int | None = None) -> list[Part]:
        """The parts of a table as of a version, the last one by default."""
        return self._list(version).get(table) or self._first(table)

    def _first(self, table: str) -> list[Part]:
        t = self.tables[table]
        size = (1 << BITS) // t.parts
        return [Part(k * size, (k + 1) * size, -1) for k in range(t.parts)] if t.key else []

    def _list(self, version: int | None = None) -> dict[str, list[Part]]:
        there = self.versions()
        if version is None:
            version = there[-1] if there else None
        if version is None:
            return {}
        if version not in there:
            raise ValueError(f"there is no version {version}")
        stream = self._files.open(self._path(f"lists/{version}.json"))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return {name: [Part(**p) for p in ps] for name, ps in json.loads(text).items()}

    def read(self, table: str, version: int | None = None) -> DataFrame:
        return self.rows(table, self.parts(table, version))

    def rows(self, table: str, parts: list[Part]) -> DataFrame:
        """The rows of some parts of a table."""
        schema = self.tables[table].schema
        paths = [f"{self.folder}/{p.path}" for p in parts if p.path]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    # ---- writing ----

    def begin(self, number: int) -> Version | None:
        """Version ``number``, from the state of the last one before it; none where it, or a later one, is done already."""
        done = self.versions()
        if done and done[-1] >= number:
            return None
        last = self._list()
        return Version(number, {name: last.get(name) or self._first(name) for name in self.tables})

    def merge(self, version: Version, table: str, changes: DataFrame, apply: Callable[[DataFrame, DataFrame], DataFrame], also: DataFrame | None = None) -> DataFrame:
        """Write anew the parts that ``changes`` has keys of, as ``apply(old rows, changes)`` gives them, and return what was written. ``changes`` is
        read twice. ``apply`` may drop rows, and must give rows with keys of ``changes`` or of the old rows only. Parts of the keys of ``also``, which is
        read if there are parts without changes, are written anew as well."""
        t, parts = self.tables[table], version.parts[table]
        where = _start_of(_hash(t.key), parts)
        come = {r["part"]: r["n"] for r in changes.groupBy(where.alias("part")).agg(F.count("*").alias("n")).collect()}
        if also is not None and any(p.path and p.start not in come for p in parts):
            come = {r["part"]: 0 for r in also.select(where.alias("part")).distinct().collect()} | come
        touched = [p for p in parts if p.start in come]
        if not touched:
            return self.rows(table, [])
        targets = [x for p in touched for x in _split(p, p.rows + come[p.start], t.rows)]
        after = sorted([p for p in parts if p.start not in come] + targets, key=lambda p: p.start)
        folder = f"rows/{table}/{version.number}"
        new = apply(self.rows(table, touched), changes).select(*t.schema.fieldNames()).withColumn("part", _start_of(_hash(t.key), after))
        new.repartition(len(targets), "part").write.mode("overwrite").partitionBy("part").parquet(f"{self.folder}/{folder}")
        written = self._names(folder)
        # counts come from the files' footers
        sizes = {r["part"]: r["n"] for r in self.spark.read.schema("part bigint").parquet(f"{self.folder}/{folder}").groupBy("part").agg(F.count("*").alias("n")).collect()} if any(n.startswith("part=") for n in written) else {}
        made = [Part(p.start, p.end, version.number, sizes.get(p.start, 0), f"{folder}/part={p.start}" if p.start in sizes else None) for p in targets]
        version.parts[table] = sorted([p for p in after if p not in targets] + made, key=lambda p: p.start)
        return self.rows(table, made)

    def append(self, version: Version, table: str, rows: DataFrame) -> None:
        """Add a segment to a table without a key; many small ones become one first."""
        t = self.tables[table]
        segments = version.parts[table]
        small = [p for p in segments if p.rows < t.rows]
        if len(segments) >= MOST_SEGMENTS and len(small) > 1:
            self._segment(version, table, self.rows(table, small), f"rows/{table}/{version.number}/merged", [p for p in segments if p not in small], max(1, sum(p.rows for p in small) // t.rows))
        self._segment(version, table, rows.select(*t.schema.fieldNames()), f"rows/{table}/{version.number}/new", version.parts[table])

    def _segment(self, version: Version, table: str, rows: DataFrame, path: str, others: list[Part], files: int | None = None) -> None:
        (rows.coalesce(files) if files else rows).write.mode("overwrite").parquet(f"{self.folder}/{path}")
        n = self.spark.read.schema(self.tables[table].schema).parquet(f"{self.folder}/{path}").count()
        at = max((p.end for p in others), default=0)
        version.parts[table] = [*others, *([Part(at, at + 1, version.number, n, path)] if n else [])]

    def commit(self, version: Version) -> None:
        self._write_list(version.number, version.parts)

    # ---- what changed, and what can go ----

    def changes(self, table: str, before: int | None, after: int | None = None, closed: str | None = None, ignore: tuple[str, ...] = ()) -> DataFrame:
        """What a keyed table's rows became from one version (none: from nothing) to another: the columns of the later row, the earlier one of those
        deleted, and ``_change``: insert, update, delete, and with ``closed``, a column that is null of open rows, close and reopen. Columns of ``ignore`` may differ.

        Only parts whose files differ are read."""
        t = self.tables[table]
        old = [] if before is None else self.parts(table, before)
        new = self.parts(table, after)
        same = {p.path for p in old} & {p.path for p in new}
        o, n = (self.rows(table, [p for p in ps if p.path not in same]).drop(*ignore).select(F.struct("*").alias(side), *(F.col(k).alias(f"__{k}") for k in t.key)) for ps, side in ((old, "o"), (new, "n")))
        # null keys are keys as well
        both = o.join(n.withColumnsRenamed({f"__{k}": f"__n_{k}" for k in t.key}), [F.col(f"__{k}").eqNullSafe(F.col(f"__n_{k}")) for k in t.key], "full_outer")
        kind = F.when(F.col("o").isNull(), "insert").when(F.col("n").isNull(), "delete")
        if closed:
            was, now = F.col(f"o.{closed}").isNotNull(), F.col(f"n.{closed}").isNotNull()
            kind = kind.when(~was & now, "close").when(was & ~now, "reopen")
        kind = kind.when(~F.col("o").eqNullSafe(F.col("n")), "update")
        return both.select(F.coalesce("n", "o").alias("r"), kind.alias("_change")).where("_change IS NOT NULL").select("r.*", "_change")

    def vacuum(self, keep: int = 2) -> int:
        """Remove all but the last ``keep`` lists, and the files that none of these names; the number of folders that went. Files of a version that is not done stay."""
        there = self.versions()
        kept = there[-max(1, keep):]
        if not kept:
            return 0
        named = {p.path for v in kept for ps in self._list(v).values() for p in ps}
        gone = 0
        for table in self.tables:
            for number in [n for n in self._names(f"rows/{table}") if int(n) <= kept[-1]]:
                folder = f"rows/{table}/{number}"
                inside = [f"{folder}/{n}" for n in self._names(folder) if not n.startswith(("_", "."))]
                for path in [p for p in inside if p not in named]:
                    gone += self._files.delete(self._path(path), True)
                if not named.intersection(inside):
                    self._files.delete(self._path(folder), True)
        for v in there[: -len(kept)]:
            self._files.delete(self._path(f"lists/{v}.json"), False)
        return gone
