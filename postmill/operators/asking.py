"""Asking a paid provider once for each key: answers go to an append-only ledger as they come, and what the ledger has is never asked again.

The provider is a function that tasks call with a few prompts at a time; there is no call of a network here. A task that dies has its finished keys in the
ledger, so the task that follows it asks for the rest alone. Keys are dealt out by hash to buckets, each a folder of the ledger and one task's at a time; with
speculative execution two tasks might ask for one key, so it is to be off. The ledger's folder is one that tasks can open, such as a mounted store.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LEDGER = "key string, attempt int, answer string, tokens bigint"
#: Prompts of a call.
CALL = 16


def _rows(path: str) -> dict[str, list[dict]]:
    out: dict[str, list[dict]] = {}
    with open(path, encoding="utf-8") as f:
        for row in map(json.loads, f):
            out.setdefault(row["key"], []).append(row)
    return out


class _Known:
    """Attempts of a bucket's keys, which are asked for in order: of the files that are complete, only those whose first and last keys are about one are held."""

    def __init__(self, folder: str):
        self.files, self.held = [], []
        for name in os.listdir(folder) if os.path.isdir(folder) else []:
            if name.endswith(".json") and name[0] not in "._" and (keys := _rows(path := os.path.join(folder, name)).keys()):
                self.files.append((min(keys), max(keys), path))
        self.files.sort(reverse=True)

    def at(self, key: str) -> list[dict]:
        self.held = [(last, rows) for last, rows in self.held if last >= key]
        while self.files and self.files[-1][0] <= key:
            _, last, path = self.files.pop()
            if last >= key:
                self.held.append((last, _rows(path)))
        return sorted((r for _, rows in self.held for r in rows.get(key, [])), key=lambda r: r["attempt"])


def _keep(folder: str, rows: list[dict]) -> None:
    """A new file of the ledger, which is there whole or not at all."""
    os.makedirs(folder, exist_ok=True)
    name = uuid.uuid4().hex
    with open(os.path.join(folder, f".{name}"), "w", encoding="utf-8") as f:
        f.writelines(json.dumps(r) + "\n" for r in rows)
        f.flush()
        os.fsync(f.fileno())
    os.rename(os.path.join(folder, f".{name}"), os.path.join(folder, f"{name}.json"))


def _asked(ask, again, folder: str, call: int):
    def settled(attempts: list[dict]) -> bool:
        return bool(attempts) and (len(attempts) > 1 or not (again and again(attempts[0]["answer"])))

    def apply(batches):
        bucket, known, last, waiting, n = None, None, None, [], 0

        def called() -> None:
            for attempt in (0, 1):
                left = [w for w in waiting if not settled(w[2]) and len(w[2]) == attempt]
                if not left:
                    continue
                answers = ask([p for _, p, _ in left], attempt)
                if len(answers) != len(left):
                    raise ValueError(f"{len(answers)} answers to {len(left)} prompts")
                rows = [{"key": k, "attempt": attempt, "answer": a, "tokens": int(t)} for (k, _, _), (a, t) in zip(left, answers)]
                _keep(f"{folder}/bucket={bucket}", rows)
                for (_, _, attempts), r in zip(left, rows):
                    attempts.append(r)
            waiting.clear()

        for batch in batches:
            for b, key, prompt in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if b != bucket:
                    if waiting:
                        called()
                    bucket, known, last = b, _Known(f"{folder}/bucket={b}"), None
                # rows of one key follow each other
                if key == last:
                    continue
                last = key
                attempts = known.at(key)
                if not settled(attempts):
                    n += 1
                    waiting.append((key, prompt, attempts))
                    if len(waiting) == call:
                        called()
        if waiting:
            called()
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    return apply


def ask_all(requests: DataFrame, ask: Callable[[list[str], int], list[tuple[str, int]]], folder: str, again: Callable[[str], bool] | None = None, key: str = "key", prompt: str = "prompt", buckets: int = 64, call: int = CALL) -> DataFrame:
    """(key, answer, attempts, tokens): the last answer to each key of ``requests`` and what all of its attempts took.

    ``ask(prompts, attempt)`` gives an answer and its tokens for each prompt; where ``again`` says so of the first answer, it is asked once more, and the second
    one is believed. Keys count as strings, each once; null keys are left out. ``buckets`` is fixed for a ledger's life."""
    spark = requests.sparkSession
    bucket = F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(buckets)).cast("int")
    rows = requests.where(F.col(key).isNotNull()).select(bucket.alias("bucket"), F.col(key).cast("string").alias("key"), F.col(prompt).cast("string").alias("prompt"))
    where = folder.removeprefix("file:").replace("//", "/")
    rows.repartition(buckets, "bucket").sortWithinPartitions("bucket", "key", "prompt").mapInArrow(_asked(ask, again, where, call), "n bigint").agg(F.sum("n")).collect()
    wanted = rows.select("key").distinct()
    last = F.max_by(F.struct("answer"), "attempt")
    found = read_ledger(spark, folder).groupBy("key").agg(last.alias("a"), F.count("*").alias("attempts"), F.sum("tokens").alias("tokens"))
    return found.join(wanted, "key", "left_semi").select("key", F.col("a.answer").alias("answer"), "attempts", "tokens")


def read_ledger(spark: SparkSession, folder: str) -> DataFrame:
    """Every attempt that was ever made."""
    where = folder.removeprefix("file:").replace("//", "/")
    if not os.path.isdir(where) or not any(n.startswith("bucket=") for n in os.listdir(where)):
        return spark.createDataFrame([], LEDGER)
    return spark.read.schema(LEDGER).json(folder).select("key", "attempt", "answer", "tokens")
