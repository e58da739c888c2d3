"""Awkward documents: nulls, empty and long texts, repeated rows, clashing column names."""

import pytest

LONG = " ".join(f"word{k % 977} and{k % 13}" for k in range(60_000))


@pytest.fixture(scope="session")
def awkward(spark):
    prose = "The quick brown fox jumps over the lazy dog and then it runs away from the angry bear"
    rows = [(1, prose, "en", "a"), (2, prose, "en", "a"), (3, prose + " again", "en", "a"), (4, None, None, None), (5, "", "en", "b"), (6, "!!! ???", None, "b"), (7, LONG, "en", "b"),
            (8, "one two three", "en", None), (8, "one two three", "en", None), (9, "être à l'école où l'été dure", "fr", "c"), (10, LONG + " tail", "en", "c"), (11, "\x00\x01 \t\n", "en", "c"), (None, "no id here", "en", "c")]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, id string, doc int, term string, key string, row string, mark string, share string, label string, n bigint, position int, host string, rate string"
    return spark.createDataFrame([(a, t, x, s, None if t is None else len(t), "x", 1, "y", "k", "r", "m", "s", "l", 3, 4, "h", "q") for a, t, x, s in rows], schema)


@pytest.fixture(scope="session")
def nothing(awkward):
    return awkward.limit(0)
