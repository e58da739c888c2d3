"""Secret scans: assignment, access-key and hex patterns, and a token-efficiency test.

A byte-pair vocabulary spends few tokens on language and identifiers and many on random strings,
so candidates with few characters per token are reported as kind ``random``. Known digests and
identifiers are excluded first: UUIDs, digests by their length or from a given set, version and
date strings, numbers, and names made of word-like parts that the vocabulary compresses well.

Null texts count as empty. Repeated rows are answered one by one. Other columns are not read.
"""

from __future__ import annotations

import base64
import re
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import strings, text_batches
from .tokens import Alphabet, spans

#: Ranks file of a public byte-pair vocabulary.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern that splits text before that vocabulary's merges.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The ranks file is broadcast; a larger one is refused.
MOST_RANK_BYTES = 16 << 20
#: Candidates of fewer characters per token than this are random.
CHARS_PER_TOKEN = 2.0

KINDS = ("assign", "access", "hex", "random")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
_UUID = re.compile(r"[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}")
_DIGEST = re.compile(r"(?:[0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{56}|[0-9a-fA-F]{64}|[0-9a-fA-F]{96}|[0-9a-fA-F]{128})")
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")


def plain(text: str, long: bool = True) -> list[tuple[str, int, int]]:
    """Pattern matches (kind, start, end), by kind, then start. ``long``: what ``has_long_run`` says of the text."""
    low, found = text.lower(), []
    if any(w in low for w in _NAMES):
        found = [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    if long and "AKIA" in text:
        found += [("access", *m.span()) for m in _ACCESS.finditer(text) if len(m[0]) >= 16]
    if long:
        found += [("hex", *m.span()) for m in _HEX.finditer(text)]
    return found


def is_identifier(word: str, encode, most: float = CHARS_PER_TOKEN) -> bool:
    """Names, paths and numbers: no letters, or parts that are words to the vocabulary, joined by separators or capitals."""
    letters = sum(c.isalpha() for c in word)
    digits = sum(c.isdigit() for c in word)
    if not letters:
        return True
    parts = _PARTS.findall(word)
    wordy = sum(len(p) for p in parts if len(p) >= 4 and p.isalpha() and not p[1:].isupper() and len(p) >= most * len(encode(p)) or p.isdigit() and len(p) in (2, 4) and len(parts) <= 8)
    return wordy >= 0.8 * (letters + digits)


def random_strings(text: str, encode, held: list[tuple[str, int, int]], known: frozenset = frozenset(), most: float = CHARS_PER_TOKEN) -> list[tuple[str, int, int]]:
    """Candidates that the vocabulary compresses badly, apart from ``held`` spans."""
    out, begins, ends = [], [], []
    for _, a, b in sorted(held, key=lambda h: h[1]):
        begins.append(a)
        ends.append(max(b, ends[-1] if ends else 0))
    for m in _CANDIDATE.finditer(text):
        word = m[0]
        if len(word) >= most * len(encode(word)) or is_identifier(word, encode, most):
            continue
        if _UUID.fullmatch(word) or _DIGEST.fullmatch(word) or word.lower() in known:
            continue
        before = bisect_left(begins, m.end())
        if not before or ends[before - 1] <= m.start():
            out.append(("random", *m.span()))
    return out


_ENCODERS: dict[int, object] = {}


def _encoder(ranks: bytes):
    key = hash(ranks)
    if key not in _ENCODERS:
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines()) }
        _ENCODERS[key] = tiktoken.Encoding("given", pat_str=SPLIT, mergeable_ranks=table, special_tokens={}).encode_ordinary
    return _ENCODERS[key]


def _joined(found: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(found, key=lambda f: (f[1], KINDS.index(f[0]))))


def _alphabet(chars: str) -> Alphabet:
    is_word = np.zeros(256, bool)
    is_word[[ord(c) for c in chars]] = True
    return Alphabet(is_word)


_LONG = _alphabet("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-")


def has_long_run(col: pa.Array, least: int = 16) -> np.ndarray:
    """For each row: has it ``least`` candidate characters in a row. Hex and access keys need that, too."""
    _, start, end, rows = spans(col, _LONG)
    long = np.concatenate([[0], np.cumsum(end - start >= least)])
    return long[rows[1:]] > long[rows[:-1]]


def _find(ranks: Broadcast, known: frozenset, most: float):
    def apply(batches):
        encode = _encoder(ranks.value)
        for batch in batches:
            rows, col = [], strings(batch.column(1))
            for text, long in zip(col.to_pylist(), has_long_run(col)):
                base = plain(text, long)
                more = random_strings(text, encode, base, known, most) if long else []
                counts = [sum(k == kind for k, _, _ in base) for kind in KINDS[:3]]
                base_spans = _joined(base)
                rows.append((*counts, base_spans, _joined(base + more) if more else base_spans, len(more)))
            kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
            cols = list(zip(*rows)) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, kinds))],
                                             names=["id", "n_assign", "n_access", "n_hex", "base_spans", "spans", "n_random"])

    return apply


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY,
                 known_digests: frozenset = frozenset(), chars_per_token: float = CHARS_PER_TOKEN) -> DataFrame:
    """(id, n_assign, n_access, n_hex, base_spans, spans, n_random) per row.

    ``known_digests``: lower-case strings that are never random; they travel with the task, so give a small set.
    """
    spark = docs.sparkSession
    text_batches(spark)
    with open(vocabulary, "rb") as f:
        ranks = f.read(MOST_RANK_BYTES + 1)
    if len(ranks) > MOST_RANK_BYTES:
        raise ValueError(f"{vocabulary} has more than {MOST_RANK_BYTES} bytes")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    find = _find(spark.sparkContext.broadcast(ranks), frozenset(known_digests), chars_per_token)
    return rows.mapInArrow(find, f"id {kind}, n_assign bigint, n_access bigint, n_hex bigint, base_spans string, spans string, n_random bigint").withColumnRenamed("id", id_col)


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document: counts and digest of the pattern spans, all spans, and how many are random strings."""
    return find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet")).select(
        "doc_id", "n_assign", "n_access", "n_hex", F.sha2(F.col("base_spans").cast("binary"), 256).alias("base_sha256"), "spans", "n_random")
