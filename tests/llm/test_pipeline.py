"""The pipeline's stages on small tables, against what the operators say."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from postmill.llm import secret_scan, soft_mixing
from postmill.llm.queries import ORACLES, QUERIES
from tests.conftest import SMALL
from tests.llm.test_operators import ASSIGN, _brute, _brute_classes, _brute_languages


def test_stages_keep_columns_and_clean_rows(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, SMALL)
        assert kept.columns == docs.columns
        assert 0 < kept.count() <= docs.count()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "decontaminate", "secrets", "mixing"]


def test_stages_equal_brute_force(spark):
    """What each stage keeps of a given table, by the brute-force versions of the operators."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").orderBy("doc_id").withColumn("text", F.when(F.col("doc_id") % 17 == 3, "123 !!").when(F.col("doc_id") % 17 == 4, F.lit(None)).otherwise(F.col("text")))
    rows = docs.collect()
    ids, texts = [r["doc_id"] for r in rows], [r["text"] for r in rows]
    kept = lambda stage: sorted(r["doc_id"] for r in stage(spark, docs, SMALL).collect())
    labelled = [(r["text"] or "", r["lang"]) for r in rows if r["lang"]]
    judged = _brute_languages([{"text": r["text"], "declared": r["lang"], "suffix": None, "host": r["source"], "domain": None} for r in rows], labelled)
    assert kept(corpus_pipeline.language) == [k for k, (_, _, rejected) in zip(ids, judged) if not rejected]
    assert kept(corpus_pipeline.near_duplicates) == [k for n, (k, (c, _)) in enumerate(zip(ids, _brute_classes(texts))) if c == n]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    hits = _brute(texts, items)
    assert kept(corpus_pipeline.decontaminate) == [k for n, k in enumerate(ids) if not hits[n][4]] and any(h[4] for h in hits.values())
    with open(secret_scan.VOCABULARY, "rb") as f:
        encode = secret_scan._encoder(f.read())

    def secret(t):
        plain = [m for m in ASSIGN.finditer(t) if len(m[2]) >= 8] + re.findall("AKIA[A-Z0-9]{12,}", t) + re.findall("[0-9a-f]{32,}", t)
        return bool(plain or secret_scan.random_strings(t, encode, []))

    assert kept(corpus_pipeline.secrets) == [k for k, t in zip(ids, texts) if not secret(t or "")]


def _brute_rates(rows, targets):
    """Rates of rows (tokens, posteriors) by projected gradient on cells of the grid, in plain numbers."""
    cells = {}
    for n, p in rows:
        ends = [int(np.floor(sum(p[: k + 1]) * soft_mixing.GRID + 0.5)) for k in range(len(p))]
        cell = tuple(b - a for a, b in zip([0, *ends], ends))
        cells.setdefault(cell, np.zeros(len(p)))
        cells[cell] += n * np.array(p)
    keys = list(cells)
    grid, expected = np.array(keys) / soft_mixing.GRID, np.array([cells[k] for k in keys])
    sizes = expected.sum(axis=0)
    whole, rate, step, before = sizes.sum(), np.ones(len(keys)), 1.0, np.inf
    for _ in range(soft_mixing.STEPS):
        off = (rate[:, None] * expected).sum(axis=0) / whole - targets
        miss = abs(off).max()
        if miss < soft_mixing.CLOSE:
            break
        step = min(step * 1.5, 16.0) if miss < before else 1.0
        before = miss
        pull = np.array([step * o * whole / s if s else 0.0 for o, s in zip(off, sizes)])
        rate = np.maximum(0.0, rate - grid @ pull)
    of = dict(zip(keys, rate))
    out = []
    for _, p in rows:
        ends = [int(np.floor(sum(p[: k + 1]) * soft_mixing.GRID + 0.5)) for k in range(len(p))]
        out.append(of[tuple(b - a for a, b in zip([0, *ends], ends))])
    return out


def test_the_whole_run_equals_brute_force(spark):
    """Ids by the stages' brute-force versions, one after the other, and rates by gradient steps in plain numbers."""
    left = [r.asDict() for r in spark.read.parquet(f"{SMALL}/documents.parquet").orderBy("doc_id").collect()]
    judged = _brute_languages([{"text": r["text"], "declared": r["lang"], "suffix": None, "host": r["source"], "domain": None} for r in left], [(r["text"] or "", r["lang"]) for r in left if r["lang"]])
    left = [r for r, (_, _, rejected) in zip(left, judged) if not rejected]
    left = [r for n, (r, (c, _)) in enumerate(zip(left, _brute_classes([r["text"] for r in left]))) if c == n]
    hits = _brute([r["text"] for r in left], [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()])
    left = [r for n, r in enumerate(left) if not hits[n][4]]
    with open(secret_scan.VOCABULARY, "rb") as f:
        encode = secret_scan._encoder(f.read())
    plain = lambda t: [m for m in ASSIGN.finditer(t) if len(m[2]) >= 8] + re.findall("AKIA[A-Z0-9]{12,}", t) + re.findall("[0-9a-f]{32,}", t)
    left = [r for r in left if not plain(r["text"] or "") and not secret_scan.random_strings(r["text"] or "", encode, [])]
    got = sorted(corpus_pipeline.run(spark, SMALL).collect(), key=lambda r: r["doc_id"])
    assert [(r["doc_id"], r["text"]) for r in got] == [(r["doc_id"], r["text"]) for r in left] and 0 < len(got) < 200
    shares = np.array(list(soft_mixing.TARGETS.values())) / sum(soft_mixing.TARGETS.values())
    rates = _brute_rates([(r["n_tokens"], [r[f"p_{d}"] for d in soft_mixing.TARGETS]) for r in got], shares)
    assert np.allclose([r["rate"] for r in got], rates, atol=2e-6) and len({round(x, 3) for x in rates}) > 3
    words = lambda t: [w for w in re.split("[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", t.lower()) if w]
    assert [r["n_tokens"] for r in got] == [len(words(r["text"] or "")) for r in got]


def test_near_duplicates_leave_one_of_each_class(spark, awkward):
    kept = sorted((r["doc_id"] or 0) for r in corpus_pipeline.near_duplicates(spark, awkward, SMALL).collect())
    assert kept == [0, 1, 4, 5, 6, 7, 8, 9, 11]


def test_run_gives_rates(spark):
    out = corpus_pipeline.run(spark, SMALL)
    assert {"doc_id", "text", "rate", "n_tokens"} <= set(out.columns) and out.where("rate < 0").count() == 0 and out.where("p_high >= 0").count() == out.count() > 0


@pytest.mark.parametrize("where", ["rate < 0", "p_high > 0.5", "n_tokens > 3"])
def test_a_filter_on_rates_repeats_no_work(spark, where):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    out = soft_mixing.mix_to_targets(docs, soft_mixing.quality_domains(spark.read.parquet(f"{SMALL}/labels.parquet")))
    size = lambda df: len(df._jdf.queryExecution().optimizedPlan().toString())
    assert size(out.where(where)) < 2 * size(out)


def test_stages_and_run_of_awkward_and_empty_tables(spark, awkward, nothing, tmp_path):
    """Each stage keeps the awkward rows that it has nothing against, whole, and makes nothing of nothing; so does the run."""
    for name in ("benchmark", "labels"):
        spark.read.parquet(f"{SMALL}/{name}.parquet").write.parquet(f"{tmp_path}/full/{name}.parquet")
        spark.read.parquet(f"{SMALL}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/none/{name}.parquet")
    kept = {"language": [1, 2, 3, 7, 8, 8, 9, 10, None], "near_duplicates": [1, 4, 5, 6, 7, 8, 9, 11, None], "decontaminate": None, "secrets": None, "mixing": None}
    every = sorted((r["doc_id"] for r in awkward.select("doc_id").collect()), key=str)
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, awkward, f"{tmp_path}/full")
        assert sorted((r["doc_id"] for r in got.select("doc_id").collect()), key=str) == (sorted(kept[name], key=str) if kept[name] else every), name
        assert name == "mixing" or got.columns == awkward.columns
        assert stage(spark, awkward, f"{tmp_path}/none").count() > 0
        assert stage(spark, nothing, f"{tmp_path}/full").count() == 0
    for rows, where in ((awkward, "full"), (nothing, "none")):
        rows.write.parquet(f"{tmp_path}/{where}/documents.parquet")
    assert sorted((r["doc_id"] for r in corpus_pipeline.run(spark, f"{tmp_path}/full").select("doc_id").collect()), key=str) == sorted([1, 7, 8, 9, None], key=str)
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


def test_texts_under_one_id_go_by_their_own_class(spark):
    long = lambda k: " ".join(f"w{k}x{j}" for j in range(40))
    rows = [(1, long(1), "a"), (1, long(2), "b"), (1, long(2), "c"), (2, long(3), "d"), (3, long(2) + " more", "e"), (4, long(3), "f"), (5, None, "g"), (5, "", "h"), (None, long(1), "i")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = sorted(r["source"] for r in corpus_pipeline.near_duplicates(spark, docs, SMALL).collect())
    # of b and c, equal, one stays; then it or e, of one class, goes: the one of id 3, if b's number isn't above it
    assert "a" in got and "d" in got and "f" not in got and {"g", "h", "i"} <= set(got) and len(got) == 6 and len({"b", "e"} & set(got)) == 1


def test_every_operator_is_registered():
    assert {int(n[2:].split("_")[0]) for n in QUERIES} == set(range(1, 14)) and set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracles(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    got = QUERIES[name](spark, SMALL)
    want = con.sql(ORACLES[name])
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    norm = lambda rows: sorted(tuple(map(str, r)) for r in rows)
    assert norm(got.select(*cols).collect()) == norm(con.sql(f"SELECT {', '.join(cols)} FROM ({ORACLES[name]})").fetchall())
