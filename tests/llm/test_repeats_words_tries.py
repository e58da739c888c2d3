"""Repeated passages, spelling variants and conversation tries, against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from postmill.llm import conversation_trie, repeats, spelling


def _docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")


# ---- 11: repeats ----


def _brute_repeats(texts, window):
    words = [(t or "").encode().split() for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for k, w in enumerate(words):
        gone = {j for i in range(len(w) - window + 1) if seen[tuple(w[i : i + window])] > 1 for j in range(i, i + window)}
        out.append((k, len(w), len(gone), b" ".join(x for j, x in enumerate(w) if j not in gone).decode()))
    return out


def _texts():
    r = random.Random(3)
    few = ["a", "b", "A", "é"]
    texts = [" ".join(r.choice(few) for _ in range(r.choice([0, 3, 5, 40, 90]))) for _ in range(50)]
    return texts + texts[:4] + [None, "", "x  y\tz\x0b\x1cw v", " ".join(["q"] * 300)]


@pytest.mark.parametrize("window, chunk, most", [(1, 50, 2), (3, 7, 1), (5, 50, 2), (6, 1 << 21, 1 << 15), (9, 50, 1), (35, 64, 1), (70, 1000, 2)])
def test_repeats_equal_brute_force(spark, window, chunk, most):
    """Small chunks cut texts, and small prefixes are all too common: the longest, and the window itself, divide them."""
    texts = _texts()
    got = repeats.without_repeats(_docs(spark, texts), window=window, chunk=chunk, most=most).collect()
    assert sorted(map(tuple, got)) == _brute_repeats(texts, window)


def test_passages_are_maximal(spark):
    shared = " ".join(f"s{k}" for k in range(50))
    texts = [f"a b {shared} c", f"d {shared}", "e f " + " ".join(f"s{k}" for k in range(40)), "no repeats at all"]
    got = {r["key"]: r["spans"] for r in repeats.repeated_passages(_docs(spark, texts)).collect()}
    assert [got.get(hashlib.sha256(t.encode()).digest()) for t in texts] == [[2, 52], [1, 51], [2, 42], None]


def test_repeats_of_awkward_rows_and_of_none(spark, awkward, nothing):
    got = {}
    for r in repeats.without_repeats(awkward).collect():
        got.setdefault(r["doc_id"], []).append(r)
    assert sum(map(len, got.values())) == awkward.count() and got[4][0]["n_words"] == got[5][0]["n_words"] == 0 and got[8][0] == got[8][1]
    assert got[7][0]["n_removed"] == got[7][0]["n_words"] == 120_000 and got[10][0]["kept"] == "tail" and got[None][0]["n_removed"] == 0
    assert repeats.without_repeats(nothing).count() == 0


# ---- 12: spelling ----


def _near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def _brute_variants(words):
    meant, near = {}, {}
    for a in words:
        others = [b for b in words if _near(a, b)]
        best = min(others, key=lambda b: (-words[b], b)) if others else None
        meant[a], near[a] = best if best and words[best] >= 5 * words[a] else None, len(others)
    out = []
    for a in words:
        root = a
        while meant[root]:
            root = meant[root]
        out.append((a, meant[a], root, words[a], near[a], words[meant[a]] if meant[a] else None))
    return sorted(out)


@pytest.mark.parametrize("letters", ["abé", "ab", "abcdefgh"])
def test_variants_equal_brute_force(spark, letters):
    """Few letters give long runs of equal ones, many ties and chains of forms."""
    r = random.Random(len(letters))
    words = {"".join(r.choice(letters) for _ in range(r.choice([1, 3, 4, 5]))): r.choice([5, 5, 6, 30, 200, 1000, 6000]) for _ in range(250)}
    got = spelling.spelling_variants(spark.createDataFrame(list(words.items()), "word string, n bigint")).collect()
    want = _brute_variants(words)
    assert sorted(map(tuple, got)) == want and (letters != "abé" or any(w[1] and w[1] != w[2] for w in want))


def test_counts_with_slips_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(spelling, "PART", 64)  # texts are cut between runs
    r = random.Random(5)
    texts = [" ".join("".join(r.choice("abÀé÷xY") for _ in range(r.choice([2, 6, 7, 9]))) + r.choice([",", "-3", ""]) for _ in range(40)) for _ in range(60)]
    want = Counter()
    for k, t in enumerate(texts + ["ABCDEFÉ" * 2, None]):
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if c < "\x7f" else c for c in run)
            h = zlib.crc32(f"{k}:{run}".encode())
            want[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 7 == 0 else run] += 1
    got = spelling.word_counts(_docs(spark, texts + ["ABCDEFÉ" * 2, None]), chars=6, least=2, slips=7)
    assert {r["word"]: r["n"] for r in got.collect()} == {w: n for w, n in want.items() if len(w) >= 6 and n >= 2}


def test_variants_of_awkward_rows_and_of_none(spark, awkward, nothing):
    got = {r["word"]: r["n"] for r in spelling.spelling_variants(spelling.word_counts(awkward, chars=5, least=1)).collect()}
    assert got["quick"] == 3 and got["école"] == 1 and got["three"] == 2 and "the" not in got
    assert spelling.spelling_variants(spelling.word_counts(nothing)).count() == 0


# ---- 13: tries ----

_NAMES = ["depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def _brute_trie(paths):
    nodes, kids = {}, {}
    for c, p in paths:
        for d in range(len(p) + 1):
            nodes.setdefault(tuple(p[:d]), []).append((c, len(p) == d))
    for p in nodes:
        if p:
            kids.setdefault(p[:-1], []).append(p)

    def below(p):
        leaves, saved = int(p not in kids), (len(nodes[p]) - 1) * p[-1][1] if p else 0
        for k in kids.get(p, []):
            a, b = below(k)
            leaves, saved = leaves + a, saved + b
        return leaves, saved

    least = lambda p: min(c for c, _ in nodes[p])
    ends = lambda p: hashlib.sha256(",".join(str(c) for c in sorted(c for c, e in nodes[p] if e)).encode()).hexdigest()
    return sorted(((len(p), least(p), least(p[:-1]) if p else None, len(m), len(kids.get(p, [])), *below(p), ends(p)) for p, m in nodes.items()), key=str)


def _trie(df, **more):
    return sorted(map(tuple, conversation_trie.prefix_trie(df, **more).select(*_NAMES).collect()), key=str)


def _conversations(n, seed):
    r = random.Random(seed)
    return [(k if k % 3 else -k, [("u", "x" * r.choice([1, 2, 3])) for _ in range(r.choice([0, 1, 2, 3, 3, 6]))] if k % 3 else [("u", "same")] * 4) for k in range(n)]


def _table(spark, convs):
    rows = [(c, None if t == 0 else t, role, text) for c, turns in convs for t, (role, text) in enumerate(turns)]
    return spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string")


@pytest.mark.parametrize("n, shard", [(1, 1), (30, 2), (120, 8), (120, 1 << 16)])
def test_trie_equals_brute_force(spark, n, shard):
    """A third of the conversations are all equal; small shards put many nodes into the skeleton, and large ones few."""
    convs = [(c, t) for c, t in _conversations(n, n) if t]
    convs = convs or [(5, [("u", "one")])]
    got = _trie(conversation_trie.paths(_table(spark, convs)), shard=shard)
    assert got == _brute_trie([(c, [(x, len(x[1])) for x in t]) for c, t in convs])


def test_trie_with_few_skeleton_nodes_and_short_pieces(spark, monkeypatch):
    convs = [(c, t) for c, t in _conversations(90, 4) if t]
    want = _brute_trie([(c, [(x, len(x[1])) for x in t]) for c, t in convs])
    paths = conversation_trie.paths(_table(spark, convs)).cache()
    monkeypatch.setattr(conversation_trie, "MOST_NODES", 20)
    assert _trie(paths, shard=6) == want
    paths.unpersist()


def test_turnless_conversations_are_members_of_the_root(spark):
    df = spark.createDataFrame([(1, b""), (2, b"")], "conv_id bigint, path binary")
    assert _trie(df) == _brute_trie([(1, []), (2, [])])


def test_rebuilt_conversations_equal_brute_force(spark):
    convs = {c: t for c, t in _conversations(60, 9) if t and c >= 0 and c != 10}
    rebuilt = []
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        rebuilt.append((c, [(x, len(x[1])) for x in convs.get(c - c % 5, [])[:h] + own[h:]]))
    assert _trie(conversation_trie.paths_with_shared_heads(_table(spark, list(convs.items()))), shard=4) == _brute_trie(rebuilt)


def test_conversations_with_nulls_ties_and_repeats(spark):
    rows = [(None, 0, "u", "x"), (1, None, None, None), (1, 0, "u", "x"), (1, 0, "u", "x"), (1, 0, "a", "y"), (2, 0, "", ""), (2, 1, "a", "y"), (2, 2, "u", "x"), (2, 3, "u", "x")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string")
    first = [(("", ""), 0), (("a", "y"), 1), (("u", "x"), 1), (("u", "x"), 1)]
    assert _trie(conversation_trie.paths(df)) == _brute_trie([(1, first), (2, first)])
    assert _trie(conversation_trie.paths(df.where("conv_id > 9"))) == []


def test_of_equal_conversations_the_skeleton_hashes_all_ids(spark, monkeypatch):
    monkeypatch.setattr(conversation_trie, "PIECE", 7)
    df = spark.range(200).select(F.col("id").alias("conv_id"), F.lit(0).alias("turn"), F.lit("u").alias("role"), F.lit("hi").alias("text"))
    got = _trie(conversation_trie.paths(df), shard=20)
    assert got == _brute_trie([(k, [(("u", "hi"), 2)]) for k in range(200)])
