"""Tables of profiles, queries, intervals and references against loops."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from postmill.operators import filters, intervals, nearest, profiles, references

POSTING = "id bigint, title string, description string, locations array<string>, remote_mode string"
PROFILE = "profile_id bigint, locations array<string>, remote_modes array<string>, seniority string, work_auth string, must_have array<string>, exclude array<string>"
TERMS = ["python", "C++", "Node.js", ".net", "machine learning", "!!", "go", "_x", "Rust ", "é", "sql"]


def _postings(r, n):
    text = lambda k: " ".join(r.choice(["Python", "python3", "c++", "C++,", "node.js", "nodexjs", "ASP.NET", "machine", "learning", "machine learning", "!!", "go", "GO.", "a_x", "_x", "rust", "É", "é", "sql", "nosql", "no sponsorship", "x"]) for _ in range(k))
    return [(k, r.choice(["Senior dev", "Intern", "Director of x", "dev", None]), r.choice([text(8), text(2), None]), r.choice([None, [], ["Oslo, Norway"], ["oslo", "Bergen"], ["Rome , Italy"]]), r.choice([None, "remote", "hybrid", "onsite"])) for k in range(n)]


def _profiles(r, n):
    some = lambda xs, most: r.sample(xs, r.randrange(most + 1))
    return [(k, r.choice([None, [], ["Oslo, Norway"], ["ROME"], ["Paris, ", "bergen"]]), r.choice([None, [], ["remote"], ["hybrid", "onsite"]]), r.choice([None, "senior", "intern", "mid"]), r.choice([None, "citizen", "needs_sponsorship"]), some(TERMS, 2) + some([" "], 1), some(TERMS, 1)) for k in range(n)]


def test_a_table_of_profiles_equals_the_loop_over_profiles(spark):
    r = random.Random(6)
    people = _profiles(r, 14)
    jobs = spark.createDataFrame(_postings(r, 120), POSTING)
    table = spark.createDataFrame(people, PROFILE)
    scored = [(p, j, None if (p + j) % 5 == 0 else 50) for p in range(14) for j in range(0, 120, 7)]
    matches = spark.createDataFrame(scored, "profile_id bigint, id bigint, score int")
    pairs, buckets, loops = [], {}, None
    for k, places, modes, level, auth, must, never in people:
        p = filters.Profile(places or [], modes or [], level, auth, must, never)
        known = matches.where(F.col("profile_id") == k).select("id", "score")
        passed = filters.already_scored(filters.with_passes(jobs, p), known, "id").select(F.lit(k).alias("k"), "id", filters.bucket(F.col("already")).alias("bucket"))
        loops = passed if loops is None else loops.unionByName(passed)
    for row in loops.collect():
        buckets.setdefault(row["k"], {}).setdefault(row["bucket"], []).append(row["id"])
        pairs += [(row["k"], row["id"])] if row["bucket"] == "candidates" else []
    got = profiles.candidates(table, jobs, matches)
    assert "CartesianProduct" not in (plan := got._jdf.queryExecution().executedPlan().toString()) and "NestedLoop" not in plan
    assert sorted(map(tuple, got.collect())) == sorted(pairs) and 100 < len(pairs)
    for row in profiles.funnels(table, jobs, matches).collect():
        want = {b: len(ids) for b, ids in buckets[row["profile_id"]].items()}
        assert {b: n for b, n in row.asDict().items() if n and b not in ("profile_id", "pool")} == want and sum(want.values()) == row["pool"] == 120


def test_texts_are_not_searched_for_one_term_after_another(spark, monkeypatch):
    """Terms of a few tokens are found by a text's runs of tokens alone, and as their patterns find them; only others are looked for."""
    looked, search = [], profiles._looked_for
    monkeypatch.setattr(profiles, "_looked_for", lambda postings, terms: looked.extend(r["term"] for r in terms.collect()) or search(postings, terms))
    texts = ["Go. C++, a_x", "\U0001d400b go.x", "node.js nodexjs (sql).", "_x !! é. go  x", "machine learning machine  learning", "x.go. a b c d", "", "GO\nsql"]
    terms = ["go", "go.", "c++", "node.js", "b", "\U0001d400b", "!!", "é.", "machine learning", ".", "x.go", "_x", "a b c d", "go\nsql"]
    postings, table = spark.createDataFrame(list(enumerate(texts)), "id bigint, text string"), spark.createDataFrame([(t,) for t in terms], "term string")
    want = postings.crossJoin(table).where(F.rlike("text", profiles.pattern_of(F.col("term")))).select("id", "term").collect()
    got = profiles.term_index(postings, table).select("id", F.explode("terms")).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(want) > 20
    assert sorted(looked) == ["_x", "a b c d"]


def test_of_texts_only_runs_that_may_be_terms_are_shuffled(spark, monkeypatch):
    """More terms than are broadcast: a set of bits lets all terms and few other runs through to the join."""
    r = random.Random(3)
    texts = [" ".join(f"w{r.randrange(3_000)}" for _ in range(150)) for _ in range(40)]
    words, terms = spark.createDataFrame([(f"w{k}",) for k in range(3_000)], "term string"), [f"w{k}" for k in range(0, 3_000, 100)] + ["w1 w2", "c++"]
    postings, table = spark.createDataFrame(list(enumerate(texts)), "id bigint, text string"), spark.createDataFrame([(t,) for t in terms], "term string")
    want = sorted(tuple(x) for x in profiles.term_index(postings, table).select("id", F.explode("terms")).collect())
    monkeypatch.setattr(profiles, "MOST_WORDS", 0)
    index = profiles.term_index(postings, table)
    assert sorted(tuple(x) for x in index.select("id", F.explode("terms")).collect()) == want and len(want) > 30
    plan = index._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("getbit") < plan.index("Generate explode")
    passed = {x["term"] for x in words.where(profiles._in_bits(F.col("term"), table, len(terms))).collect()}
    assert passed >= set(terms[:30]) and len(passed) < 300


def test_no_profiles_and_no_postings(spark):
    jobs, none = spark.createDataFrame(_postings(random.Random(1), 5), POSTING), spark.createDataFrame([], PROFILE)
    one = spark.createDataFrame([(1, None, None, None, None, None, None)], PROFILE)
    assert profiles.candidates(none, jobs).count() == 0 and profiles.candidates(one, jobs.limit(0)).count() == 0 and profiles.candidates(one, jobs).count() == 5


def test_blocks_and_chunks_of_any_size_give_the_same(spark, monkeypatch):
    """Small blocks, ids that are no numbers, and no row for a profile and a posting before it has passed."""
    r = random.Random(8)
    jobs = spark.createDataFrame(_postings(r, 90), POSTING).withColumn("id", F.concat(F.lit("p"), "id"))
    table = spark.createDataFrame(_profiles(r, 11), PROFILE)
    matches = spark.createDataFrame([(p, f"p{j}", 1) for p in range(11) for j in range(0, 99, 9)], "profile_id bigint, id string, score int")
    whole, counts = profiles.candidates(table, jobs, matches).collect(), profiles.funnels(table, jobs, matches).collect()
    monkeypatch.setattr(profiles, "BLOCK", 13)
    monkeypatch.setattr(profiles, "CHUNK", 3)
    monkeypatch.setattr(profiles, "BATCH", 5)
    got = profiles.candidates(table, jobs, matches)
    assert sorted(got.collect()) == sorted(whole) and len(whole) > 50
    assert sorted(profiles.funnels(table, jobs, matches).collect()) == sorted(counts) and all(sum(row[2:]) == row["pool"] == 90 for row in counts)


def _brute_nearest(queries, vectors, k, cap):
    out = []
    for q, a in queries:
        ranked = sorted((round(1 - float(np.dot(a, b)) / (np.linalg.norm(a) * np.linalg.norm(b)), 9) + 0.0, i, g) for i, g, b in vectors if np.any(b))
        held = {}
        kept = [(i, d) for d, i, g in ranked if not cap or held.setdefault(g, []).append(i) is None and len(held[g]) <= cap][:k]
        out += [(q, i, n + 1) for n, (i, _) in enumerate(kept)]
    return sorted(out)


@pytest.mark.parametrize("cap, blocks", [(None, (3, 11)), (2, (3, 11)), (2, (100, 1000))])
def test_nearest_of_each_equals_brute_force(spark, monkeypatch, cap, blocks):
    """Whole numbers give ties by the dozen; equal and zero vectors are there."""
    monkeypatch.setattr(nearest, "CHUNK", 4)
    r = np.random.default_rng(3)
    vectors = [(i, int(r.integers(4)), r.integers(-1, 2, 3).astype(float)) for i in range(60)]
    queries = [(f"q{k}", v) for k, (_, _, v) in enumerate(vectors[:9]) if np.any(v)]
    v = spark.createDataFrame([(i, None if g == 3 else g, b.tolist()) for i, g, b in vectors] + [(900, 1, None), (901, 1, [1.0])], "vec_id bigint, employer bigint, embedding array<double>")
    q = spark.createDataFrame([(k, a.tolist()) for k, a in queries], "query_id string, embedding array<double>")
    got = nearest.nearest_of_each(q, v, 7, 3, group="employer", cap=cap, queries_a_block=blocks[0], vectors_a_block=blocks[1]).select("query_id", "vec_id", "rank").collect()
    assert sorted(map(tuple, got)) == _brute_nearest(queries, vectors, 7, cap)


@pytest.mark.parametrize("salts", [1, 3])
def test_overlaps_equal_the_nested_loop(spark, salts):
    r = random.Random(4)
    make = lambda n, s: [(k, r.choice("ab"), a := r.randrange(-300, 300), a + r.choice([0, 1, 5, 40, 2000, -1])) for k in range(n)] + [(s, "a", None, 3)]
    left, right = make(150, 1000), make(120, 2000)
    schema = "k bigint, g string, lo bigint, hi bigint"
    got = intervals.overlaps(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), "lo", "hi", 7, ("g",), salts)
    want = sorted((a[0], b[0]) for a in left for b in right if None not in (a[2], b[2]) and a[1] == b[1] and a[2] <= a[3] and b[2] <= b[3] and a[2] <= b[3] and b[2] <= a[3])
    assert sorted((x["l"]["k"], x["r"]["k"]) for x in got.collect()) == want


def test_rows_of_keys_with_few_others_are_joined_once_and_without_bins(spark, monkeypatch):
    """One side has few rows of most keys; only crowded keys go by bins, and none where there are none."""
    r = random.Random(5)
    rows = lambda n, keys: [(k, r.choice(keys), a := r.randrange(300), a + r.choice([0, 3, 900])) for k in range(n)]
    left, right = rows(300, ["a", "b", "c", None]), rows(12, ["a", "c", "d", None]) + [(20 + k, "b", k, k + 5) for k in range(90)]
    schema = "k bigint, g string, lo bigint, hi bigint"
    ours, theirs = spark.createDataFrame(left, schema), spark.createDataFrame(right, schema)
    want = sorted((a[0], b[0]) for a in left for b in right if a[1] is not None and a[1] == b[1] and a[2] <= b[3] and b[2] <= a[3])
    seen, bins = [], intervals._by_bins
    monkeypatch.setattr(intervals, "_by_bins", lambda a, b, *more: seen.append({x["__l0"] for x in a.collect()}) or bins(a, b, *more))
    for few, binned in ((4, [{"a", "b", "c"}]), (40, [{"b"}]), (100, [])):
        monkeypatch.setattr(intervals, "FEW", few)
        seen.clear()
        got = intervals.overlaps(ours, theirs, "lo", "hi", 7, ("g",))
        assert sorted((x["l"]["k"], x["r"]["k"]) for x in got.collect()) == want and len(seen) == len(binned)
        assert all(found <= keys for found, keys in zip(seen, binned))
    assert "sequence" not in got._jdf.queryExecution().optimizedPlan().toString()


def _write(spark, tmp_path):
    n = iter(range(1000))

    def write(rows, what):
        path = f"{tmp_path}/{what}-{next(n)}"
        rows.write.parquet(path)
        return spark.read.schema(rows.schema).parquet(path)

    return write


def test_deletes_go_through_a_graph_of_tables(spark, tmp_path):
    tables = {"a": spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, None)], "id int, boss int"), "b": spark.createDataFrame([(10, 1), (11, 3), (12, 4), (13, None)], "id int, a int"),
              "c": spark.createDataFrame([(20, 10, 4), (21, 12, 3), (22, 12, 4)], "id int, b int, a int"), "d": spark.createDataFrame([(30, 20), (31, 21)], "id int, c int")}
    keys = [references.ForeignKey("a", "boss", "a", "id"), references.ForeignKey("b", "a", "a", "id"), references.ForeignKey("c", "b", "b", "id"), references.ForeignKey("c", "a", "a", "id", references.SET_NULL), references.ForeignKey("d", "c", "c", "id")]
    ids, write = dict.fromkeys(tables, "id"), _write(spark, tmp_path)
    left = references.delete_cascading(tables, {"a": spark.createDataFrame([(1,), (99,)], "id int")}, keys, ids, write)
    assert {t: sorted(map(tuple, rows.collect()), key=str) for t, rows in left.items()} == {"a": [(4, None)], "b": [(12, 4), (13, None)], "c": [(21, 12, None), (22, 12, 4)], "d": [(31, 21)]}
    with pytest.raises(ValueError, match="still refers"):
        references.delete_cascading(tables, {"c": spark.createDataFrame([(20,)], "id int")}, [references.ForeignKey("d", "c", "c", "id", references.RESTRICT)], ids, write)
    with pytest.raises(ValueError, match="circle"):
        references.order(["x", "y"], [references.ForeignKey("x", "y", "y", "id"), references.ForeignKey("y", "x", "x", "id")])


def test_unique_keys_refuse_rows(spark):
    here = spark.createDataFrame([(1, "a"), (2, None)], "id int, slot string")
    taken, refused = references.insert_unique(here, spark.createDataFrame([(1, "z"), (3, "a"), (4, "b"), (5, "b"), (6, None), (7, None), (None, "q")], "id int, slot string"), [["id"], ["slot"]])
    assert sorted(map(tuple, taken.collect()), key=str) == [(6, None), (7, None), (None, "q")]
    assert sorted(map(tuple, refused.collect())) == [(1, "z", "id"), (3, "a", "slot"), (4, "b", "slot"), (5, "b", "slot")]
