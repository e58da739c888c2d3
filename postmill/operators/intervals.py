"""Pairs of overlapping intervals of two tables, by bins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import shared_path

#: Of an interval's bins, in which it is joined, there are so many at most: longer intervals have wider bins.
MOST_BINS = 4
#: Where one side has so few rows of a key, its rows meet those of the other as they are: a row has so many others at most to be compared with.
FEW = 64


def _level(low: Column, high: Column, width: float) -> Column:
    """Bins of level l are width * 2^l wide: the least level at which an interval has MOST_BINS at most."""
    steps = (high - low) / F.lit(float(width * (MOST_BINS - 1)))
    return F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(steps, F.lit(1.0))))).cast("int")


def _bin(value: Column, level: Column, width: float) -> Column:
    return F.floor(value / (F.lit(float(width)) * F.pow(F.lit(2.0), level))).cast("bigint")


def overlaps(left: DataFrame, right: DataFrame, low: str, high: str, width: float, on: tuple[str, ...] = (), salts: int = 1) -> DataFrame:
    """All pairs of rows of ``left`` and ``right`` whose closed intervals [low, high] overlap, with equal ``on`` columns: structs ``l`` and ``r``, each pair once.

    Rows of a key of which one side has FEW are joined by the key alone, each shuffled once; other keys, which are counted first, go by bins, as all rows do without ``on``.
    Bins are ``width`` wide, about the length of a usual interval, and twice, four times, ... as wide for longer ones. Intervals of one level are joined where
    they have a bin in common, and those of others at the wider one's level; of the bins that two have in common, the one in which the later of them begins counts, so no
    pair comes twice and none has to be made distinct. Bins and levels are keys of a plain equi-join. ``salts`` divides a bin that holds a large part of all rows: rows of ``right`` are
    dealt out over so many parts, and those of ``left`` copied to each. Rows with a null or inverted interval have no overlap."""
    names = [F.col(c) for c in on]

    def prepared(rows: DataFrame, name: str) -> DataFrame:
        a, b = F.col(low).cast("double"), F.col(high).cast("double")
        return rows.where(a <= b).select(F.struct("*").alias(name), *(c.alias(f"__{name}{k}") for k, c in enumerate(names)), a.alias(f"{name}_low"), b.alias(f"{name}_high"), _level(a, b, width).alias(f"{name}_level"))

    ours, theirs = prepared(left, "l"), prepared(right, "r")
    if not on:
        return _by_bins(ours, theirs, width, 0, salts)
    keys = lambda name: [F.col(f"__{name}{k}").alias(f"__{k}") for k in range(len(on))]
    counted = lambda rows, name: rows.groupBy(*keys(name)).agg(F.count("*").alias(f"n_{name}")).where(F.col(f"n_{name}") > FEW)
    named = [f"__{k}" for k in range(len(on))]
    crowded, path = counted(ours, "l").join(counted(theirs, "r"), named).select(*named), shared_path(left.sparkSession, "crowded")
    crowded.write.parquet(path)
    crowded = left.sparkSession.read.schema(crowded.schema).parquet(path)
    same = [F.col(f"__l{k}") == F.col(f"__r{k}") for k in range(len(on))]
    meet = (F.col("l_low") <= F.col("r_high")) & (F.col("r_low") <= F.col("l_high"))
    if crowded.isEmpty():
        return ours.join(theirs, same).where(meet).select("l", "r")

    def of(rows: DataFrame, name: str, how: str) -> DataFrame:
        return rows.join(crowded, [F.col(f"__{name}{k}") == F.col(f"__{k}") for k in range(len(on))], how)

    plain = of(ours, "l", "left_anti").join(of(theirs, "r", "left_anti"), same).where(meet).select("l", "r")
    return plain.unionByName(_by_bins(of(ours, "l", "left_semi"), of(theirs, "r", "left_semi"), width, len(on), salts))


def _by_bins(ours: DataFrame, theirs: DataFrame, width: float, keys: int, salts: int) -> DataFrame:
    """Pairs of rows with a bin in common, by levels; ``keys`` are the key columns."""
    # a side meets the other at every level that it has, from its own level up
    levels = lambda rows, name: F.broadcast(rows.select(F.col(f"{name}_level").alias("level")).distinct())  # noqa: E731  some sixty at most

    def dealt(rows: DataFrame, name: str, others: DataFrame, strict: bool) -> DataFrame:
        mine = F.col(f"{name}_level")
        up = rows.join(others, (F.col("level") > mine) if strict else (F.col("level") >= mine))
        return up.withColumn("bin", F.explode(F.sequence(_bin(F.col(f"{name}_low"), F.col("level"), width), _bin(F.col(f"{name}_high"), F.col("level"), width))))

    def own(rows: DataFrame, name: str) -> DataFrame:
        at = F.sequence(_bin(F.col(f"{name}_low"), F.col(f"{name}_level"), width), _bin(F.col(f"{name}_high"), F.col(f"{name}_level"), width))
        return rows.withColumn("level", F.col(f"{name}_level")).withColumn("bin", F.explode(at))

    def met(a: DataFrame, b: DataFrame) -> DataFrame:
        if salts > 1:
            a = a.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
            b = b.withColumn("salt", F.pmod(F.xxhash64("r_low", "r_high", F.to_json("r")), F.lit(salts)).cast("int"))
        both = a.join(b, [a[f"__l{k}"] == b[f"__r{k}"] for k in range(keys)] + [a["level"] == b["level"], a["bin"] == b["bin"]] + ([a["salt"] == b["salt"]] if salts > 1 else []))
        first = a["bin"] == _bin(F.greatest("l_low", "r_low"), a["level"], width)
        return both.where((F.col("l_low") <= F.col("r_high")) & (F.col("r_low") <= F.col("l_high")) & first).select("l", "r")

    wide_right = met(dealt(ours, "l", levels(theirs, "r"), strict=False), own(theirs, "r"))
    wide_left = met(own(ours, "l"), dealt(theirs, "r", levels(ours, "l"), strict=True))
    return wide_right.unionByName(wide_left)
