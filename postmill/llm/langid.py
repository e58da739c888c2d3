"""Language identification by Bayesian fusion of evidence.

A row's language has a posterior proportional to the product of

- its text's likelihood under smoothed trigram distributions learnt from labelled texts, tempered
  because trigrams of one text are not independent;
- the likelihood of the language that its markup declares, and of its address suffix (country
  domain, or a two-letter first path segment), each given the language;
- a prior of its host, smoothed by that of its domain, and that by the corpus's.

The last three are not given but learnt: the text-only posteriors of all rows are summed by
declared language, suffix, host and domain in grouped aggregations, and each row leaves its own
share out. One more class, ``und``, spreads evenly over all trigrams and takes texts in no known
language.

Rows with no letters have no text evidence. A row is rejected where ``und`` wins or there is no
text evidence. Null or unknown evidence counts for nothing. Repeated rows are answered one by one.
"""

from __future__ import annotations

import html

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import strings, text_batches, written
from .tokens import raw_bytes

UNKNOWN = "und"
BUCKETS = 1 << 15
#: The model has one row of BUCKETS numbers per language and is broadcast; more languages are refused.
MOST_LANGUAGES = 64
TEMPER, MOST_GRAMS = 0.2, 400
UNKNOWN_PRIOR = 0.02
HOST_WEIGHT, DOMAIN_WEIGHT, TOKEN_WEIGHT = 8.0, 32.0, 4.0
#: Posteriors are summed in units of 1 / UNIT, so that sums do not depend on their order.
UNIT = 10_000
_CHUNK = 1 << 20

_CODES = np.zeros(256, np.uint32)
_CODES[97:123] = np.arange(1, 27)
_CODES[65:91] = np.arange(1, 27)
_CODES[128:] = np.arange(27, 155)


def page_text(markup: str) -> str:
    """Text outside tags, comments, scripts and styles, in one pass over the pieces between angle brackets."""
    first, *pieces = markup.split("<")
    out, until = [first], None
    for piece in pieces:
        if until:
            if until == "-->":
                if "-->" in piece:
                    out.append(piece.rpartition("-->")[2])
                    until = None
                continue
            if not piece[:8].lower().startswith(until):
                continue
            until = None
        if piece.startswith("!--"):
            body = piece[3:].partition("-->")
            if body[1]:
                out.append(body[2])
            else:
                until = "-->"
            continue
        tag, _, text = piece.partition(">")
        name = tag[:7].lower()
        if name.startswith(("script", "style")) and not tag.endswith("/"):
            until = "/script" if name.startswith("script") else "/style"
            continue
        out.append(text)
    return html.unescape(" ".join(out))


def _gram_slots(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of the trigram that ends at each byte from the third on, and whether it has two letters or more."""
    code = _CODES[data]
    h = (code[:-2] * np.uint32(0x9E3779B1) + code[1:-1]) * np.uint32(0x85EBCA6B) + code[2:]
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    letters = (code[:-2] > 0).astype(np.int8) + (code[1:-1] > 0) + (code[2:] > 0)
    return (h >> np.uint32(17)).astype(np.int64), letters >= 2


def _grams(col: pa.Array):
    """(rows, slots) of all trigrams, in chunks; none crosses rows."""
    data, offsets = raw_bytes(col)
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    for a in range(0, max(0, len(data) - 2), _CHUNK):
        b = min(len(data), a + _CHUNK + 2)
        slots, use = _gram_slots(data[a:b])
        use &= ~edge[a + 1 : b - 1] & ~edge[a + 2 : b]
        at = np.flatnonzero(use)
        yield np.searchsorted(offsets, at + a, side="right") - 1, slots[at]


def _counts(batches):
    with np.errstate(over="ignore"):
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            names = batch.column(0).to_pylist()
            for name in set(names):
                total.setdefault(name, np.zeros(BUCKETS, np.int64))
            for rows, slots in _grams(batch.column(1)):
                for name in set(names):
                    mine = np.array([n == name for n in names])
                    total[name] += np.bincount(slots[mine[rows]], minlength=BUCKETS)
        for name, n in total.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at)), pa.array(at), pa.array(n[at])], names=["language", "slot", "n"])


class TextModel:
    """Languages and, for each and for ``und`` last, the log probability of every bucket."""

    def __init__(self, languages: list[str], weights: np.ndarray):
        self.languages, self.weights = languages, weights


def fit_text_model(labelled: DataFrame, text_col: str = "text", language_col: str = "lang") -> TextModel:
    """Learn from every labelled row; what reaches the driver is at most MOST_LANGUAGES * BUCKETS numbers."""
    text_batches(labelled.sparkSession, 256)
    rows = labelled.select(F.lower(F.trim(F.col(language_col).cast("string"))).alias("language"), F.col(text_col).cast("string").alias("text"))
    rows = rows.where("language is not null and language <> ''")
    languages = [r[0] for r in rows.where(F.col("language") != UNKNOWN).select("language").distinct().orderBy("language").limit(MOST_LANGUAGES + 1).collect()]
    if len(languages) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    counts = np.full((len(languages) + 1, BUCKETS), 0.5)
    found = rows.where(F.col("language").isin(languages)).mapInArrow(_counts, "language string, slot bigint, n bigint").groupBy("language", "slot").agg(F.sum("n").alias("n")).toArrow()
    place = {name: k for k, name in enumerate(languages)}
    counts[[place[x] for x in found["language"].to_pylist()], found["slot"].to_numpy()] += found["n"].to_numpy()
    counts[-1] = 1.0
    return TextModel(languages, np.log(counts / counts.sum(axis=1, keepdims=True)).astype(np.float32))


def _posteriors(model: Broadcast, markup: bool):
    def apply(batches):
        weights = model.value.weights
        prior = np.full(len(weights), (1 - UNKNOWN_PRIOR) / max(1, len(weights) - 1))
        prior[-1] = UNKNOWN_PRIOR
        with np.errstate(over="ignore"):
            for batch in batches:
                col = strings(batch.column(1))
                if markup:
                    col = pa.array([page_text(x) for x in col.to_pylist()], pa.large_string())
                n = len(col)
                grams, log = np.zeros(n), np.zeros((len(weights), n))
                for rows, slots in _grams(col):
                    grams += np.bincount(rows, minlength=n)
                    for k, w in enumerate(weights):
                        log[k] += np.bincount(rows, weights=w[slots], minlength=n)
                log *= TEMPER * np.minimum(grams, MOST_GRAMS) / np.maximum(grams, 1)
                log -= log.max(axis=0, keepdims=True)
                p = np.exp(log) * prior[:, None]
                p /= p.sum(axis=0, keepdims=True)
                share = np.floor(p * UNIT + 0.5).astype(np.int64)
                flat = lambda x, t: pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * len(weights), pa.int32()), pa.array(x.T.reshape(-1), t))
                yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], pa.array(grams.astype(np.int64)), flat(log, pa.float64()), flat(share, pa.int64())],
                                                 names=[batch.schema.names[0], *batch.schema.names[2:], "n_grams", "log", "share"])

    return apply


KEYS = ("declared", "suffix", "host", "domain")


def _sums(rows: DataFrame, n: int) -> DataFrame:
    """(kind, value, sums): posteriors summed over the rows of each value of each key, in one pass."""
    pairs = F.stack(F.lit(len(KEYS)), *(x for key in KEYS for x in (F.lit(key), F.col(key)))).alias("kind", "value")
    sums = F.array(*[F.sum(F.col("share")[k]) for k in range(n)])
    return written(rows.select("share", pairs).where("value is not null").groupBy("kind", "value").agg(sums.alias("sums")), "evidence")


def fuse(log: np.ndarray, share: np.ndarray, voted: np.ndarray, sums: dict[str, tuple[np.ndarray, np.ndarray]], overall: np.ndarray) -> np.ndarray:
    """Log posteriors (rows, languages), up to a constant of each row.

    ``log``: text evidence; ``share``: posteriors by text alone, in parts of UNIT; ``voted``: is the row's
    share in the sums; ``sums``: for each key the sums of the row's value and whether it has one;
    ``overall``: the sums of all rows."""
    n, whole = log.shape[1], overall.sum()
    own = np.where(voted[:, None], share, 0)
    left = {key: np.where(there[:, None], np.maximum(of - own, 0), 0) / UNIT for key, (of, there) in sums.items()}
    p = np.broadcast_to((overall + UNIT) / (whole + n * UNIT), log.shape)
    for key, weight in (("domain", DOMAIN_WEIGHT), ("host", HOST_WEIGHT)):
        p = (left[key] + weight * p) / (left[key].sum(axis=1, keepdims=True) + weight)
    out = log + np.log(p)
    for key in ("declared", "suffix"):
        # likelihood of this value given the language, over its likelihood overall
        part = (left[key].sum(axis=1, keepdims=True) + TOKEN_WEIGHT) / (whole / UNIT + TOKEN_WEIGHT)
        given = (left[key] + TOKEN_WEIGHT * part) / ((overall - own) / UNIT + TOKEN_WEIGHT)
        out += np.where(sums[key][1][:, None], np.log(given / part), 0.0)
    return out


def _decisions(languages: list[str], overall: np.ndarray):
    """Rows (id, host, declared, suffix, n_grams, log, share, <key>_sums…) to their language."""
    names, n = np.array([*languages, UNKNOWN], object), len(languages) + 1

    def table(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        there = np.asarray(col.is_valid())
        out = np.zeros((len(col), n), col.type.value_type.to_pandas_dtype())
        out[there] = col.flatten().to_numpy(zero_copy_only=False).reshape(-1, n)
        return out, there

    def apply(batches):
        for batch in batches:
            grams = batch.column("n_grams").to_numpy()
            log, share = table(batch.column("log"))[0], table(batch.column("share"))[0]
            logs = fuse(log, share, grams > 0, {key: table(batch.column(f"{key}_sums")) for key in KEYS}, overall)
            best = logs.argmax(axis=1)
            posterior = 1 / np.exp(logs - logs.max(axis=1, keepdims=True)).sum(axis=1)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(names[log.argmax(axis=1)], pa.string(), mask=grams == 0), pa.array(names[best], pa.string()),
                 pa.array(np.round(posterior, 6)), pa.array((best == n - 1) | (grams == 0))],
                names=["id", "host", "declared", "suffix", "n_grams", "text_lang", "lang", "posterior", "rejected"])

    return apply


def identify(rows: DataFrame, model: TextModel, id_col: str, text_col: str, declared: Column | None = None, suffix: Column | None = None,
             host: Column | None = None, domain: Column | None = None, markup: bool = False) -> DataFrame:
    """(id, host, declared, suffix, n_grams, text_lang, lang, posterior, rejected) per row.

    Null ids are kept as they are. Evidence that is null or blank counts for nothing. A row's own posterior is
    left out of the sums, but not its text of ``model``: where the model was learnt from the same rows and the
    label is also the declared language, that label counts twice."""
    spark = rows.sparkSession
    text_batches(spark, 128)
    n = len(model.languages) + 1
    text = lambda c: F.nullif(F.lower(F.trim(c.cast("string"))), F.lit("")) if c is not None else F.lit(None).cast("string")
    picked = rows.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), text(declared).alias("declared"), text(suffix).alias("suffix"), text(host).alias("host"), text(domain).alias("domain"))
    kind = picked.schema["id"].dataType.simpleString()
    weights = spark.sparkContext.broadcast(model)
    scored = written(picked.mapInArrow(_posteriors(weights, markup),
                                       f"id {kind}, declared string, suffix string, host string, domain string, n_grams bigint, log array<double>, share array<bigint>"), "languages")
    weights.destroy()
    overall = np.array([v or 0 for v in scored.agg(*[F.sum(F.col("share")[k]) for k in range(n)]).first()], np.int64)
    # A row without text evidence would only add its prior to the sums.
    sums, joined = _sums(scored.where("n_grams > 0"), n), scored
    for key in KEYS:
        joined = joined.join(sums.where(F.col("kind") == key).select(F.col("value").alias(key), F.col("sums").alias(f"{key}_sums")), key, "left")
    out = joined.select("id", "host", "declared", "suffix", "n_grams", "log", "share", *(f"{key}_sums" for key in KEYS)).mapInArrow(
        _decisions(model.languages, overall), f"id {kind}, host string, declared string, suffix string, n_grams bigint, text_lang string, lang string, posterior double, rejected boolean")
    return out.withColumnRenamed("id", id_col)


def page_evidence(url: Column, markup: Column) -> dict[str, Column]:
    """Declared language of a page's markup, and suffix, host and domain of its address."""
    host = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    labels = F.split(host, r"\.")
    top = F.element_at(labels, -1)
    segment = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([A-Za-z]{2})(?:[/?#]|$)", 1))
    suffix = F.when(F.length(top) == 2, F.concat(F.lit("."), top)).when(segment != "", F.concat(F.lit("/"), segment))
    declared = F.regexp_extract(F.coalesce(markup, F.lit("")), r"(?i)<html\b[^<>]*?\blang\s*=\s*[\"']?([a-z]{2,3})", 1)
    domain = F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), ".")
    return {"declared": declared, "suffix": suffix, "host": host, "domain": domain}


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every page, by text, markup, address and host; the text model is learnt from the labelled documents."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    model = fit_text_model(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return identify(pages, model, "page_id", "html", markup=True, **page_evidence(F.col("url"), F.col("html")))
