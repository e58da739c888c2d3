"""A ledger of answers: nothing is asked twice, whatever dies."""

import os
import random

import pytest

from postmill.operators import asking


def _provider(log, dies_at=None):
    def ask(prompts, attempt):
        with open(log, "a") as f:
            f.writelines(f"{attempt} {p}\n" for p in prompts)
        if dies_at in prompts:
            raise RuntimeError("the provider is gone")
        return [("nothing" if attempt == 0 and p.endswith("3") else f"{p} answered {attempt}", 5) for p in prompts]

    return ask


def _calls(log):
    with open(log) as f:
        return f.read().split("\n")[:-1]


def test_a_key_is_paid_for_once(spark, tmp_path):
    log, folder = f"{tmp_path}/log", f"{tmp_path}/ledger"
    rows = [(k, f"p{k}") for k in range(40)] + [(3, "p3"), (None, "x")]
    df = spark.createDataFrame(rows, "key int, prompt string")
    again = lambda answer: answer == "nothing"
    with pytest.raises(Exception, match="provider is gone"):
        asking.ask_all(df, _provider(log, "p17"), folder, again, buckets=3, call=2).collect()
    done = {r["key"] for r in asking.read_ledger(spark, folder).collect()}
    paid = len(_calls(log))
    assert "17" not in done
    got = {r["key"]: (r["answer"], r["attempts"], r["tokens"]) for r in asking.ask_all(df, _provider(log), folder, again, buckets=3, call=2).collect()}
    assert got == {str(k): (f"p{k} answered 1", 2, 10) if k % 10 == 3 else (f"p{k} answered 0", 1, 5) for k in range(40)}
    assert not done & {line.split(" p")[1] for line in _calls(log)[paid:] if line.startswith("0")}  # what was finished wasn't asked again
    before = len(_calls(log))
    assert asking.ask_all(df.where("key < 5"), _provider(log), folder, again, buckets=3).count() == 5 and len(_calls(log)) == before
    assert asking.read_ledger(spark, folder).count() == 44


def test_half_written_files_do_not_count(spark, tmp_path):
    os.makedirs(f"{tmp_path}/bucket=0")
    with open(f"{tmp_path}/bucket=0/.half", "w") as f:
        f.write('{"key": "1", "att')
    df = spark.createDataFrame([(1, "p1")], "key int, prompt string")
    assert [r["answer"] for r in asking.ask_all(df, _provider(f"{tmp_path}/log"), str(tmp_path), buckets=1).collect()] == ["p1 answered 0"]


def test_answers_are_counted(spark, tmp_path):
    df = spark.createDataFrame([(1, "p1")], "key int, prompt string")
    with pytest.raises(Exception, match="0 answers to 1 prompts"):
        asking.ask_all(df, lambda prompts, attempt: [], str(tmp_path)).collect()
    assert asking.read_ledger(spark, str(tmp_path)).count() == 0


def test_no_task_holds_a_ledger(spark, tmp_path, monkeypatch):
    """Files are held about the key that is asked for, and each attempt is found, whatever the order of the files."""
    r = random.Random(3)
    keys = sorted(str(k) for k in range(300))
    for at in range(0, 300, 7):
        asking._keep(f"{tmp_path}/b", [{"key": k, "attempt": 0, "answer": "x", "tokens": 1} for k in keys[at : at + 7]])
        asking._keep(f"{tmp_path}/b", [{"key": k, "attempt": 1, "answer": "y", "tokens": 1} for k in keys[at : at + 7 : 3]])
    asking._keep(f"{tmp_path}/b", [{"key": k, "attempt": 1, "answer": "z", "tokens": 1} for k in ("é", "zz")])
    known, most = asking._Known(f"{tmp_path}/b"), 0
    for n, k in enumerate([*keys, "zz", "é"]):
        if r.random() < 0.8:
            want = [1] if n >= 300 else [0, 1] if n % 7 % 3 == 0 else [0]
            assert [a["attempt"] for a in known.at(k)] == want
            most = max(most, len(known.held))
    assert most <= 3
