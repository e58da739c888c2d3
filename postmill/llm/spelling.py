"""Spelling variants of a corpus's words by permuterm rotations.

A word marked with a terminator, ``word$``, has a rotation for each of its characters: ``ord$w``, ``rd$wo``, and so on. In the rotation
that ends with a character, all the rest of the word is a prefix. So two words that differ in one replaced
character agree in a rotation but for its last character, and a word that lacks one of another's characters has a whole
rotation that is the other's without its last character. Rotations are dealt out by that prefix and sorted; a scan then finds each
prefix's words side by side: all that stand there are neighbours of each other, at most one for each letter and one without.

A word isn't paired with its neighbours: it gets their number, and the most frequent one, from each of its prefixes, and these
are summed by word. Two words that differ by a replacement meet once. A word with a run of equal letters meets the
word with one letter less once for each letter of the run; only the first counts.

Forms (the most frequent neighbour, where it is frequent enough to be what was meant) lead to words several times as frequent, so
chains of them are short: roots are found by doubling, in as many rounds as the largest count allows.

Null texts have no words; a null id counts as empty; repeated rows count again; the result for an empty table is empty.
"""

from __future__ import annotations

import math
import re
import zlib

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import strings, text_batches, written

RUN = re.compile("[A-Za-zÀ-ÿ]+")
_OTHER = re.compile("[^A-Za-zÀ-ÿ]")
#: Words taken: of so many characters and occurrences at least.
CHARS, LEAST = 6, 5
#: A form occurs at least so many times as often as its variant.
TIMES = 5
#: One of so many (document, run) pairs, by hash, has a character left out.
SLIPS = 199
END = "$"
#: Words whose counts a task holds before it sends them on, and characters of a text looked at in one go.
HELD, PART = 1 << 18, 1 << 22


def _parts(text: str):
    """The text in parts that don't cut a run."""
    at = 0
    while at < len(text):
        cut = _OTHER.search(text, min(at + PART, len(text)))
        end = cut.start() if cut else len(text)
        yield text[at:end]
        at = end


def _slipped(run: str, crc: int, every: int) -> str:
    if crc % every:
        return run
    at = crc % len(run)
    return run[:at] + run[at + 1 :]


def _counts(chars: int, every: int | None):
    """Partial counts (word, n)."""

    def ready(held):
        batch = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])
        held.clear()
        return batch

    def apply(batches):
        held: dict[str, int] = {}
        for batch in batches:
            lowered = pc.ascii_lower(strings(batch.column(1)))
            for key, text in zip(batch.column(0).to_pylist(), lowered.to_pylist()):
                before = zlib.crc32(f"{key or ''}:".encode())
                for part in _parts(text):
                    for run in RUN.findall(part):
                        if len(run) < chars:
                            continue
                        if every:
                            run = _slipped(run, zlib.crc32(run.encode(), before), every)
                        held[run] = held.get(run, 0) + 1
                    if len(held) >= HELD:
                        yield ready(held)
        yield ready(held)

    return apply


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars: int = CHARS, least: int = LEAST, slips: int | None = None) -> DataFrame:
    """(word, n) of runs of letters, A to Z in lower case, that have ``chars`` characters and ``least`` occurrences or more. With ``slips``, runs of
    one in so many documents and runs, by CRC-32 of ``id:run``, lose a character first. Stored in the shared folder."""
    text_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"))
    counts = rows.mapInArrow(_counts(chars, slips), "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return written(counts.where((F.col("n") >= least) & (F.char_length("word") >= chars)), "words")


def rotations(words: DataFrame) -> DataFrame:
    """(prefix, last, n): every rotation of every marked word, as a whole (last is empty), and without its last character."""
    size = F.char_length("word")
    places = F.explode(F.sequence(F.lit(0), size)).alias("at")
    rest = F.concat(F.expr("substring(word, at + 1)"), F.lit(END), F.expr("substring(word, 1, at)"))
    skipped = F.concat(F.expr("substring(word, at + 2)"), F.lit(END), F.expr("substring(word, 1, at)"))
    both = F.array(F.struct(rest.alias("prefix"), F.lit("").alias("last")), F.struct(skipped.alias("prefix"), F.expr("substring(word, at + 1, 1)").alias("last")))
    # at the end there is no character to skip
    return words.select("word", "n", places).select("n", F.explode(F.when(F.col("at") < F.char_length("word"), both).otherwise(F.slice(both, 1, 1))).alias("r")).select("r.prefix", "r.last", "n")


def _group(prefix: str, members: list[tuple[str, int]]):
    """(word, near, n, best) of each word of a prefix: how many neighbours it has there, and the most frequent one."""
    after, before = prefix.split(END)
    tail = before[-1:]
    words = [(before + last + after, last, n) for last, n in members]
    ranked = sorted((-n, word) for word, _, n in words)[:2]
    lone = {last for _, last, _ in words if last and last != tail}  # the first of a run of equal letters
    whole = any(not last for _, last, _ in words)
    letters = len(words) - whole
    for word, last, _ in words:
        best = ranked[0] if ranked[0][1] != word else ranked[1]
        near = letters - 1 + (whole and last in lone) if last else len(lone)
        yield word, int(near), -best[0], best[1]


def _scan(batches):
    """Groups of rotations (prefix, last, n) that come sorted by prefix; a group that a batch may have cut waits for the next one."""
    held = None

    def found(table: pa.Table):
        prefix = table.column("prefix").combine_chunks()
        same = pc.equal(prefix[1:], prefix[:-1]).to_numpy(zero_copy_only=False)
        out, at = [], 0
        alike = same.nonzero()[0]
        if len(alike):
            some = table.take(pa.array(sorted({*alike.tolist(), *(alike + 1).tolist()})))
            keys, lasts, ns = (some.column(c).to_pylist() for c in ("prefix", "last", "n"))
            while at < len(keys):
                end = at + 1
                while end < len(keys) and keys[end] == keys[at]:
                    end += 1
                out += _group(keys[at], list(zip(lasts[at:end], ns[at:end])))
                at = end
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 4, (pa.string(), pa.int64(), pa.int64(), pa.string()))], names=["word", "near", "n", "best"])

    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([*(held.to_batches() if held is not None else []), batch])
        keys = table.column("prefix")
        cut = table.num_rows - 1
        while cut > 0 and keys[cut - 1].as_py() == keys[table.num_rows - 1].as_py():
            cut -= 1
        held = table.slice(cut).combine_chunks()
        if cut:
            yield found(table.slice(0, cut))
    if held is not None:
        yield found(held)


def neighbours(words: DataFrame) -> DataFrame:
    """(word, n_near, best, best_n) for words (word, n) that others differ from by one inserted, deleted or replaced character."""
    scanned = rotations(words).repartition("prefix").sortWithinPartitions("prefix", "last").mapInArrow(_scan, "word string, near bigint, n bigint, best string")
    best = F.min(F.struct((-F.col("n")).alias("n"), "best"))
    return (scanned.groupBy("word").agg(F.sum("near").alias("n_near"), best.alias("b"))
            .select("word", "n_near", F.col("b.best").alias("best"), (-F.col("b.n")).alias("best_n")))


def _roots(forms: DataFrame, largest: int, least: int, times: int) -> DataFrame:
    """(word, root) of forms (word, form): each round follows twice as many forms as the one before."""
    longest = max(1, math.ceil(math.log(max(largest, 1) / max(least, 1), times))) if times > 1 else largest
    roots = forms.select("word", F.col("form").alias("root"))
    for _ in range(math.ceil(math.log2(longest))):
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("further"))
        roots = written(roots.join(further, "root", "left").select("word", F.coalesce("further", "root").alias("root")), "roots")
    return roots


def spelling_variants(words: DataFrame, times: int = TIMES) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of words (word, n), each word once."""
    near = neighbours(words)
    meant = F.col("best_n") >= times * F.col("n")
    all_words = written(words.join(near, "word", "left").select(
        "word", F.when(meant, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.when(meant, F.col("best_n")).alias("form_n")), "variants")
    forms = all_words.where("form IS NOT NULL")
    sizes = all_words.agg(F.max("n").alias("largest"), F.min("n").alias("least")).first()
    roots = _roots(forms, sizes["largest"] or 1, sizes["least"] or 1, times)
    return all_words.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents, with slips, and the forms that they are variants of."""
    return spelling_variants(word_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), slips=SLIPS))


_BYTES = "lambda x: CASE WHEN ord(x) < 128 THEN [ord(x)::BIGINT, 0, 0, 0, 0, 0, 0, 0] ELSE [195, 0, 0, 0, 0, 0, 0, 0, ord(x)::BIGINT - 64, 0, 0, 0, 0, 0, 0, 0] END"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP12_SQL = f"""
WITH RECURSIVE o AS (SELECT doc_id, run, count(*) AS k FROM (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents) WHERE length(run) >= {CHARS} GROUP BY 1, 2),
h AS (SELECT run, k, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, ''), {_BYTES}))), lambda a, x: xor(xor(a, x) >> 1, 3988292384 * (xor(a, x) & 1))), 4294967295) AS h FROM o),
w AS MATERIALIZED (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM (SELECT k, CASE WHEN h % {SLIPS} = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM h) WHERE length(word) >= {CHARS} GROUP BY word HAVING sum(k) >= {LEAST}),
r AS (SELECT word, n, substr(word, 1, i - 1) || '*' || substr(word, i + 1) AS open, substr(word, 1, i - 1) || substr(word, i + 1) AS less FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)),
p AS (SELECT a.word, b.word AS other, b.n FROM r AS a JOIN r AS b ON a.open = b.open AND a.word <> b.word
      UNION SELECT r.word, w.word, w.n FROM r JOIN w ON r.less = w.word UNION SELECT w.word, r.word, r.n FROM r JOIN w ON r.less = w.word),
b AS (SELECT word, count(*) AS n_near, max(n) AS most FROM p GROUP BY word),
f AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= {TIMES} * w.n THEN most END AS form_n, CASE WHEN most >= {TIMES} * w.n THEN (SELECT min(other) FROM p WHERE p.word = w.word AND p.n = b.most) END AS form FROM w LEFT JOIN b USING (word)),
t(word, top) AS (SELECT word, word FROM f UNION ALL SELECT t.word, f.form FROM t JOIN f ON f.word = t.top WHERE f.form IS NOT NULL)
SELECT f.word, f.form, t.top AS root, f.n, CAST(f.n_near AS BIGINT) AS n_near, CAST(f.form_n AS BIGINT) AS form_n FROM f JOIN t USING (word) JOIN f AS e ON e.word = t.top AND e.form IS NULL
"""
