"""Mixing sources to target weights by soft membership, in DataFrame functions only.

A classifier learnt from labelled rows (presence of the most telling words and surface features,
one distribution per domain) gives every document posteriors over the domains. Nonnegative rates
per document are then fitted by projected-gradient least squares, so that the expected tokens per
domain, rate * tokens * posterior summed over documents, match the targets.

A document's rate is that of its cell: documents whose posteriors are equal on a grid, whose number
has a bound that the corpus does not move. A cell carries the expected tokens per domain of its
documents by their posteriors as they are, not rounded, so totals are matched exactly. Each
gradient step is one aggregation over the cells, of which one number per domain comes back. Steps end when
every domain's share is within ``CLOSE`` of its target, or after ``STEPS``; the largest miss is returned as
a column, and a warning is given where it is not within ``CLOSE``. Posteriors are worked out once and written with
what is carried, and rates are rows of a table of cells, joined on the cell: a filter on the result's columns
reaches a stored column, and repeats no expression.

Null texts count as empty: no words, and a rate like other documents of such posteriors. Without
labelled rows all domains are equally likely. Labels of one id are taken once, the least domain in
order; labels without a domain that has a target are left out. Repeated rows are answered one by one.
Columns of the documents that are named like one of the result's are kept, with ``_in`` after their name.
"""

from __future__ import annotations

import json
import math
import warnings
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import written

#: Labelled rows the classifier learns from, about: beyond it rows are taken by a hash of their id.
TRAINING_ROWS = 20_000
#: Words and features that the classifier knows.
FEATURES = 256
#: Parts of one on the grid that makes cells of posteriors.
GRID = 32
#: Cells that are broadcast at most (some 50 bytes each).
MOST_CELLS = 1 << 16
STEPS = 60
CLOSE = 1e-4
#: Naive likelihoods of one text are not independent; their logarithm is scaled.
TEMPER = 0.5
TARGETS = {"high": 0.80, "low": 0.18, "toxic": 0.02}


def _words(text: Column) -> Column:
    # a class of what separates: its complement is several times slower in Java
    return F.split(F.lower(text), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _bin(value: Column, name: str, steps: list[float]) -> Column:
    return F.concat(F.lit(f"#{name}"), reduce(lambda a, b: a + b, [(value >= s).cast("int") for s in steps]).cast("string"))


def features(text: Column) -> Column:
    """Words, and binned surface features as words that begin with #."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    size = F.greatest(F.length(text), F.lit(1))
    share = lambda chars: (size - F.length(F.regexp_replace(text, chars, ""))) / size
    lines = F.split(text, "\n")
    surface = F.array(
        _bin(share("[A-Z]+"), "upper", [0.01, 0.05, 0.2, 0.5]), _bin(share("[!#$%&*|{}<>]+"), "signs", [0.001, 0.01, 0.03, 0.1]), _bin(share("[0-9]+"), "digits", [0.001, 0.01, 0.05, 0.2]),
        _bin(size.cast("double"), "size", [100.0, 300.0, 1000.0, 3000.0, 10000.0]), _bin(F.size(F.array_distinct(lines)) / F.size(lines), "lines", [0.3, 0.6, 0.9, 1.0]))
    return F.concat(_words(text), surface)


#: Maps are searched entry by entry, so features are kept in so many small ones, by hash.
SLOTS = 64


def _slot(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(SLOTS)).cast("int")


class Classifier:
    """Domains, their base log likelihoods, and for each feature its slot and the log odds that it adds when present."""

    def __init__(self, domains: list[str], base: list[float], odds: dict[str, tuple[int, list[float]]]):
        self.domains, self.base, self.odds = domains, base, odds

    def _table(self) -> Column:
        """One small map for each slot; the empty word, which is no feature, keeps every map from being empty."""
        maps: list[dict[str, list[float]]] = [{"": [0.0] * len(self.domains)} for _ in range(SLOTS)]
        for word, (slot, odds) in self.odds.items():
            maps[slot][word] = odds
        return F.array(*(F.create_map(*(x for w, o in m.items() for x in (F.lit(w), F.array(*(F.lit(float(v)) for v in o))))) for m in maps))

    def with_posteriors(self, rows: DataFrame, text: Column) -> DataFrame:
        """``rows`` and, in the order of the domains, ``__p``, an array of posteriors, and ``__cell``, the same in parts of GRID that sum to GRID.

        Built column by column: each later one refers to earlier ones more than once, and is not to repeat their work."""
        n = len(self.domains)
        kept = [F.col(f"`{c}`") for c in rows.columns]
        if self.odds:
            out = rows.select(*kept, F.array_intersect(features(text), F.array(*(F.lit(w) for w in self.odds))).alias("__present"))
            table = self._table()
            # the sizes keep Spark from merging the steps: lambdas are not compiled, and what they stood on would not be either
            odds = F.when(F.size("__present") >= 0, F.transform("__present", lambda w: F.element_at(F.element_at(table, _slot(w) + 1), w)))
            out = out.select(*kept, odds.alias("__odds"))
            add = lambda k: lambda acc, o: acc + o[k]
            logs = [F.aggregate("__odds", F.lit(float(self.base[k])), add(k)) for k in range(n)]
        else:
            out, logs = rows, [F.lit(float(b)) for b in self.base]
        out = out.select(*kept, *(x.alias(f"__log{k}") for k, x in enumerate(logs)))
        top = F.greatest(*(F.col(f"__log{k}") for k in range(n))) if n > 1 else F.col("__log0")
        out = out.select(*kept, *(F.exp(TEMPER * (F.col(f"__log{k}") - top)).alias(f"__e{k}") for k in range(n)))
        total = reduce(lambda a, b: a + b, [F.col(f"__e{k}") for k in range(n)])
        out = out.select(*kept, *((F.col(f"__e{k}") / total).alias(f"__p{k}") for k in range(n)))
        # rounded running sums give parts that sum to the whole
        ends = [F.floor(reduce(lambda a, b: a + b, [F.col(f"__p{j}") for j in range(k + 1)]) * GRID + 0.5).cast("int") for k in range(n)]
        out = out.select(*kept, F.array(*(F.col(f"__p{k}") for k in range(n))).alias("__p"), *(e.alias(f"__c{k}") for k, e in enumerate(ends)))
        return out.select(*kept, "__p", F.array(F.col("__c0"), *(F.col(f"__c{k}") - F.col(f"__c{k - 1}") for k in range(1, n))).alias("__cell"))


def fit_classifier(docs: DataFrame, labels: DataFrame, domains: list[str], id_col: str = "doc_id", text_col: str = "text", domain_col: str = "domain",
                   rows: int = TRAINING_ROWS, size: int = FEATURES) -> Classifier:
    """Learn from about ``rows`` labelled documents at most; ``size`` features reach the driver."""
    known = (labels.select(F.col(id_col).alias("id"), F.col(domain_col).alias("domain")).where(F.col("domain").isin(domains) & F.col("id").isNotNull())
             .groupBy("id").agg(F.min("domain").alias("domain")))
    n = known.count()
    if n > rows:
        known = known.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(1_000_000 * rows / n))
    known = written(known, "labelled")
    # about TRAINING_ROWS ids at most: small enough to broadcast, and texts stay where they are
    training = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(known), "id")
    per = written(training.select("domain", F.explode(F.array_distinct(features(F.col("text")))).alias("word")).where("word <> ''")
                  .groupBy("word").agg(*(F.count_if(F.col("domain") == d).alias(f"n{k}") for k, d in enumerate(domains))), "features")
    sizes = {r["domain"]: r["n"] for r in training.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    totals = [sizes.get(d, 0) for d in domains]
    whole = sum(totals)
    base = [math.log((t + 1) / (whole + len(domains))) for t in totals]
    if not whole:
        return Classifier(domains, [0.0] * len(domains), {})
    # mutual information of presence and domain, by what presence and absence contribute
    present = reduce(lambda a, b: a + b, [F.col(f"n{k}") for k in range(len(domains))])
    part = lambda x, p, t: F.when(x > 0, x * F.log(x * whole / (p * t))).otherwise(0.0)
    gain = reduce(lambda a, b: a + b, [part(F.col(f"n{k}"), present, F.lit(t)) + part(t - F.col(f"n{k}"), whole - present, F.lit(t)) for k, t in enumerate(totals) if t])
    best = per.withColumns({"gain": F.round(gain, 6), "slot": _slot(F.col("word"))}).orderBy(F.desc("gain"), "word").limit(size).collect()
    odds = {}
    for r in best:
        rate = [(r[f"n{k}"] + (sum(r[f"n{j}"] for j in range(len(domains))) + 0.5) / (whole + 1)) / (t + 1) for k, t in enumerate(totals)]
        odds[r["word"]] = (r["slot"], [math.log(p / (1 - p)) for p in rate])
        base = [b + math.log(1 - p) for b, p in zip(base, rate)]
    return Classifier(domains, base, odds)


def _rate(cell: Column, pulls: list[list[float]], domains: int) -> Column:
    """Rate after the given steps from 1: each lowers it by the domains' pulls, weighted by posteriors, and keeps it nonnegative."""
    # as one literal, so that the steps' plans have the same compiled code
    steps = F.from_json(F.lit(json.dumps(pulls)), "array<array<double>>")
    along = lambda p: reduce(lambda a, b: a + b, [p[k] * cell[k] for k in range(domains)]) / GRID
    return F.aggregate(steps, F.lit(1.0), lambda r, p: F.greatest(F.lit(0.0), r - along(p)))


def fit_rates(cells: DataFrame, targets: list[float], steps: int = STEPS, close: float = CLOSE) -> tuple[list[list[float]], float]:
    """Projected-gradient steps over cells (cell, expected: tokens per domain), as pulls per domain, and the largest miss after them.

    Least squares of expected tokens against targets (shares of all tokens), each domain's weighted by
    the inverse of its size; in that metric a unit step is stable, since posteriors sum to one. Steps
    grow while the largest miss shrinks, and begin at one again when it doesn't.
    """
    n = len(targets)
    got = lambda rate: [F.sum(rate * F.col("expected")[k]) for k in range(n)]
    sizes = [v or 0.0 for v in cells.agg(*got(F.lit(1.0))).first()]
    whole = sum(sizes)
    if not whole:
        return [], 0.0
    pulls: list[list[float]] = []
    now, step, before = sizes, 1.0, math.inf
    while True:
        off = [x / whole - t for x, t in zip(now, targets)]
        miss = max(map(abs, off))
        if miss < close or len(pulls) == steps:
            return pulls, miss
        step = min(step * 1.5, 16.0) if miss < before else 1.0
        before = miss
        pulls.append([round(step * o * whole / s, 12) if s else 0.0 for o, s in zip(off, sizes)])
        now = [v or 0.0 for v in cells.agg(*got(_rate(F.col("cell"), pulls, n))).first()]


def mix_to_targets(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, id_col: str = "doc_id", text_col: str = "text",
                   domain_col: str = "domain", carry: list[str] | None = None) -> DataFrame:
    """Columns ``carry`` of ``docs`` (all by default) with n_tokens, p_<domain>, rate and target_miss; targets are taken as
    shares of their sum, of the corpus's tokens. What is carried is written once."""
    domains, total = list(targets), sum(targets.values())
    model = fit_classifier(docs, labels, domains, id_col, text_col, domain_col)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    mine = docs.columns if carry is None else carry
    taken, names = {"n_tokens", "rate", "target_miss", *(f"p_{d}" for d in domains)}, {}
    for c in mine:
        names[c] = c
        while names[c] in taken:
            names[c] += "_in"
        taken.add(names[c])
    # the classifier's words, so that texts are split once
    tokens = F.size(F.array_remove(_words(text), "")).cast("bigint")
    kept = docs.select(*(F.col(f"`{c}`").alias(names[c]) for c in mine), text.alias("__text"), tokens.alias("n_tokens"))
    scored = model.with_posteriors(kept, F.col("__text")).drop("__text")
    scored = written(scored, "posteriors")
    expected = F.array(*(F.sum(F.col("n_tokens") * F.col("__p")[k]) for k in range(len(domains))))
    cells = written(scored.groupBy(F.col("__cell").alias("cell")).agg(expected.alias("expected")), "cells")
    pulls, miss = fit_rates(cells, [t / total for t in targets.values()])
    if miss >= CLOSE:
        warnings.warn(f"expected shares of tokens miss their targets by up to {miss:.2g}", stacklevel=2)
    rates = written(cells.select(F.col("cell").alias("__cell"), F.round(_rate(F.col("cell"), pulls, len(domains)), 6).alias("__rate")), "rates")
    # cells are ways to deal GRID parts to the domains: 561 for three of them; sent everywhere only where that is few
    if math.comb(GRID + len(domains) - 1, GRID) <= MOST_CELLS:
        rates = F.broadcast(rates)
    return scored.join(rates, "__cell").select(*(F.col(f"`{names[c]}`") for c in mine), "n_tokens", *(F.col("__p")[k].alias(f"p_{d}") for k, d in enumerate(domains)),
                                               F.col("__rate").alias("rate"), F.lit(float(miss)).alias("target_miss"))


def quality_domains(labels: DataFrame) -> DataFrame:
    """(doc_id, domain) of labels (doc_id, quality, toxic): toxic, else high or low quality."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "high").when(F.col("quality") == 0, "low")
    return labels.select("doc_id", domain.alias("domain"))


def op10_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens, domain posteriors and rate of every document, and by how much the expected shares miss their targets at most."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix_to_targets(docs, quality_domains(spark.read.parquet(f"{sf_dir}/labels.parquet")), carry=["doc_id"])
