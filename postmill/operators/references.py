"""Rows that go when rows they refer to are deleted: closure over declared foreign keys, and constraints of new rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CASCADE, SET_NULL, RESTRICT = "cascade", "set null", "restrict"


@dataclass(frozen=True)
class ForeignKey:
    """``table.column`` refers to ``parent.key``; ``action`` is what a delete of the parent does."""

    table: str
    column: str
    parent: str
    key: str
    action: str = CASCADE


def order(tables: list[str], keys: list[ForeignKey]) -> list[str]:
    """Parents before what refers to them. Cycles of cascades through several tables are refused; a table may refer to itself."""
    left, out = list(tables), []
    while left:
        free = [t for t in left if not any(k.table == t and k.parent in left and k.parent != t for k in keys)]
        if not free:
            raise ValueError(f"foreign keys of {', '.join(left)} go round in a circle")
        out += free
        left = [t for t in left if t not in free]
    return out


def delete_cascading(tables: dict[str, DataFrame], gone: dict[str, DataFrame], keys: list[ForeignKey], ids: dict[str, str], write: Callable[[DataFrame, str], DataFrame], rounds: int = 64) -> dict[str, DataFrame]:
    """All tables after the rows of ``gone`` (a table's name: its ids, in a column named as ``ids`` has it) are deleted, with all that has to go with them.

    Tables are gone through once, parents first: a row goes where it is deleted itself or a cascading reference of it is to a row that goes; in a table that refers
    to itself this is done level by level. Then null takes the place of other references to what is gone. A restricting reference to a row that goes, from one that
    stays, is an error. ``write`` stores a table and gives it back, so that plans don't grow with the depth of references."""
    dead: dict[str, DataFrame] = {}
    for name in order(list(tables), keys):
        rows, key = tables[name], ids[name]
        lost = gone[name].select(F.col(key).alias("id")) if name in gone else rows.select(F.col(key).alias("id")).limit(0)
        lost = lost.join(rows.select(F.col(key).alias("id")), "id", "left_semi")
        own = [k for k in keys if k.table == name and k.parent == name and k.action == CASCADE]
        for k in keys:
            if k.table == name and k.parent != name and k.action == CASCADE:
                lost = lost.unionByName(_referring(rows, key, k, tables, dead[k.parent], ids))
        lost = write(lost.distinct(), f"gone-{name}")
        fresh = lost
        for _ in range(rounds if own else 0):
            more = None
            for k in own:
                some = _referring(rows, key, k, tables, fresh, ids)
                more = some if more is None else more.unionByName(some)
            fresh = write(more.distinct().join(lost, "id", "left_anti"), f"gone-{name}")
            if fresh.isEmpty():
                break
            lost = write(lost.unionByName(fresh), f"gone-{name}")
        else:
            if own and not fresh.isEmpty():
                raise ValueError(f"references of {name} to itself are more than {rounds} deep")
        dead[name] = lost
    out = {}
    for name, rows in tables.items():
        kept = rows.join(dead[name].withColumnRenamed("id", ids[name]), ids[name], "left_anti").select(*rows.columns)
        for k in keys:
            if k.table != name or k.action == CASCADE:
                continue
            parents = _values(tables, dead[k.parent], k, ids).select(F.col("value").alias("__gone")).distinct()
            joined = kept.join(parents, F.col(k.column) == F.col("__gone"), "left")
            if k.action == RESTRICT:
                if not joined.where("__gone IS NOT NULL").isEmpty():
                    raise ValueError(f"{name}.{k.column} still refers to rows of {k.parent} that are to go")
                continue
            kept = joined.withColumn(k.column, F.when(F.col("__gone").isNull(), F.col(k.column))).drop("__gone")
        out[name] = kept
    return out


def _values(tables: dict[str, DataFrame], dead: DataFrame, k: ForeignKey, ids: dict[str, str]) -> DataFrame:
    """What the rows that go have in the column that is referred to."""
    if k.key == ids[k.parent]:
        return dead.select(F.col("id").alias("value"))
    return tables[k.parent].join(dead.withColumnRenamed("id", ids[k.parent]), ids[k.parent], "left_semi").select(F.col(k.key).alias("value"))


def _referring(rows: DataFrame, key: str, k: ForeignKey, tables: dict[str, DataFrame], dead: DataFrame, ids: dict[str, str]) -> DataFrame:
    return rows.join(_values(tables, dead, k, ids).withColumnRenamed("value", k.column), k.column, "left_semi").select(F.col(key).alias("id"))


def insert_unique(current: DataFrame, new: DataFrame, unique: list[list[str]]) -> tuple[DataFrame, DataFrame]:
    """New rows that no unique key refuses, and those that one does, with ``conflict``, the first such key's columns, a comma between.

    A row conflicts with one that is there, or with any other new row of the same key: which of two came first isn't known, so neither is taken. A key with a null in it is no key."""
    marked = new
    for k, cols in enumerate(unique):
        there = current.select(*cols).dropna().distinct().withColumn(f"__there{k}", F.lit(True))
        counts = new.select(*cols).dropna().groupBy(*cols).agg((F.count("*") > 1).alias(f"__twice{k}"))
        marked = marked.join(there, cols, "left").join(counts, cols, "left")
    conflict = F.coalesce(*(F.when(F.coalesce(f"__there{k}", F.lit(False)) | F.coalesce(f"__twice{k}", F.lit(False)), ",".join(cols)) for k, cols in enumerate(unique)))
    marked = marked.withColumn("conflict", conflict)
    return marked.where("conflict IS NULL").select(*new.columns), marked.where("conflict IS NOT NULL").select(*new.columns, "conflict")
