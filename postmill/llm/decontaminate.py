"""Benchmark decontamination by a distributed positional inverted index.

One pass over the corpus stores, for every document, the postings (word, position) that can take
part in a match: words of the benchmark that stand in a run of benchmark words at least as long as
the shortest window. The benchmark's words are known to that pass as a bit set of fixed size, so
what is broadcast does not grow; a false positive of the set only stores a posting too many.

Queries start from the rarest word of each window: its posting list, shifted by the word's offset
in the item, gives candidate alignments (document, item, shift). Each alignment is then
intersected with the shifted lists of the other words of the windows that it is the rarest of, and
runs of consecutive matches at least a window long are the exact phrase matches. Proximity matches relax the equal
shift to shifts within a band, for the words of an item that the corpus has least of: they find
passages into which words were put, or in which some were changed.

Words are compared by 64-bit hashes. Null texts have no words; items without words or without an
id match nothing; repeated rows are answered one by one; an empty benchmark contaminates nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import lists, text_batches, written
from .tokens import LETTERS, hash_words

#: Words in a row that make a match; an item of fewer words is one window.
WINDOW = 10
#: Bits of the broadcast set of benchmark words: 2 MB, whatever the benchmark's size.
VOCAB_BITS = 1 << 24
#: Proximity: words of an item that are looked for, how many of them must stand near each other, and within what difference of shifts.
RARE_WORDS, NEAR_WORDS, BAND = 8, 4, 16


def _word_lists(batches):
    for batch in batches:
        words, rows = hash_words(batch.column(1), LETTERS)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), lists(words.view(np.int64), rows, pa.int64())], names=["id", "terms"])


def item_words(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, item_id, terms): one row per item that has words and an id; repeated rows count once."""
    text_batches(items.sparkSession)
    rows = items.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null")
    kind = rows.schema["id"].dataType.simpleString()
    return written(
        rows.mapInArrow(_word_lists, f"id {kind}, terms array<bigint>")
        .where("size(terms) > 0").distinct()
        .select(F.monotonically_increasing_id().alias("item"), F.col("id").alias("item_id"), "terms"), "items")


def vocabulary(items: DataFrame, bits: int = VOCAB_BITS) -> np.ndarray:
    """Bit set of the items' words as a bool array of ``bits`` entries; at most bits/64 rows reach the driver."""
    rows = (items.select(F.explode("terms").alias("term")).select(F.pmod("term", F.lit(bits)).alias("slot"))
            .select(F.shiftright("slot", 6).alias("at"), F.expr("shiftleft(1L, int(slot & 63))").alias("bit"))
            .groupBy("at").agg(F.bit_or("bit").alias("bit")).toArrow())
    words = np.zeros(bits // 64, np.uint64)
    words[rows["at"].to_numpy()] = rows["bit"].to_numpy().view(np.uint64)
    return np.unpackbits(words.view(np.uint8), bitorder="little").view(bool)


def _postings(packed: bytes, bits: int, run: int, rare: bytes | None):
    """A function of Arrow batches (id, text) -> (id, n_words, positions, terms)."""

    def apply(batches):
        known = np.unpackbits(np.frombuffer(packed, np.uint8)).view(bool)
        alone = None if rare is None else np.unpackbits(np.frombuffer(rare, np.uint8)).view(bool)
        for batch in batches:
            words, rows = hash_words(batch.column(1), LETTERS)
            n = len(words)
            slot = words.view(np.int64) % bits
            # a run ends at an unknown word and at the end of a row
            inside = known[slot]
            first = np.zeros(n + 1, bool)
            first[rows] = True
            new = np.ones(n, bool)
            if n:
                new[1:] = (inside[1:] != inside[:-1]) | first[1:n]
            starts = np.flatnonzero(new)
            sizes = np.diff(np.append(starts, n))
            keep = inside & np.repeat(sizes >= run, sizes) if n else inside
            if alone is not None:
                keep |= alone[slot]
            at = np.flatnonzero(keep)
            offsets = np.searchsorted(at, rows)
            position = at - np.repeat(rows[:-1], np.diff(offsets))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.diff(rows), pa.int64()), lists(position.astype(np.int32), offsets, pa.int32()),
                 lists(words.view(np.int64)[at], offsets, pa.int64())],
                names=["id", "n_words", "positions", "terms"])

    return apply


def _known_counts(packed: bytes, bits: int):
    """Partial counts (term, n) of the words that the bit set has."""

    def apply(batches):
        known = np.unpackbits(np.frombuffer(packed, np.uint8)).view(bool)
        for batch in batches:
            words, _ = hash_words(batch.column(0), LETTERS)
            terms, n = np.unique(words[known[words.view(np.int64) % bits]], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(terms.view(np.int64)), pa.array(n)], names=["term", "n"])

    return apply


def rare_words(docs: DataFrame, items: DataFrame, text_col: str = "text", most: int = RARE_WORDS) -> DataFrame:
    """(item, place, term): each item's ``most`` different words that the documents have, but least often, then that come first, with all their places."""
    text_batches(docs.sparkSession)
    known = np.packbits(vocabulary(items)).tobytes()
    lengths = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(_known_counts(known, VOCAB_BITS), "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("length"))
    places = _places(items).select("item", "place", "term")
    first = places.groupBy("item", "term").agg(F.min("place").alias("first")).join(lengths, "term")
    rank = F.row_number().over(W.partitionBy("item").orderBy("length", "first"))
    return written(places.join(first.withColumn("rank", rank).where(F.col("rank") <= most).select("item", "term"), ["item", "term"]), "rare")


def build_index(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                window: int = WINDOW, rare: DataFrame | None = None) -> DataFrame:
    """(doc, id, n_words, positions, terms): the postings of every document, stored in the shared folder.

    With ``rare`` (item, place, term) their words are stored wherever they stand.
    """
    spark = docs.sparkSession
    text_batches(spark)
    run = items.agg(F.min(F.least(F.lit(window), F.size("terms")))).first()[0] or window
    known = np.packbits(vocabulary(items)).tobytes()
    alone = None if rare is None else np.packbits(vocabulary(rare.select(F.array("term").alias("terms")))).tobytes()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    index = rows.mapInArrow(_postings(known, VOCAB_BITS, run, alone),
                            f"id {kind}, n_words bigint, positions array<int>, terms array<bigint>")
    return written(index.withColumn("doc", F.monotonically_increasing_id()), "postings")


def _places(items: DataFrame) -> DataFrame:
    return items.select("item", F.size("terms").alias("n"), F.posexplode("terms").alias("place", "term"))


def _exploded(index: DataFrame) -> DataFrame:
    """(doc, position, term) of an index."""
    pairs = F.explode(F.arrays_zip("positions", "terms")).alias("p")
    return index.select("doc", pairs).select("doc", F.col("p.positions").alias("position"), F.col("p.terms").alias("term"))


def phrase_matches(index: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc, item, first, last): maximal runs of consecutive words, a window or longer, that item and document share.

    An anchor is the rarest word of one or several windows, which follow one another. Where a posting of it stands, only
    the words of these windows are looked up about it, less than two windows of them, however long the item is."""
    postings = _exploded(index)
    places = _places(items)
    lengths = postings.groupBy("term").agg(F.count("*").alias("length"))
    span = W.partitionBy("item").orderBy("place").rowsBetween(0, window - 1)
    rarest = (places.join(lengths, "term", "left")
              .withColumn("rarest", F.min(F.struct(F.coalesce("length", F.lit(0)).alias("length"), "place", "term")).over(span))
              .where(F.col("place") <= F.greatest(F.col("n") - window, F.lit(0)))
              .where("rarest.length > 0")
              .groupBy("item", F.col("rarest.place").alias("anchor"), F.col("rarest.term").alias("term")).agg(F.min("place").alias("low"), F.max("place").alias("high")))
    needed = F.least(F.lit(window), F.size("terms"))
    about = F.slice("terms", F.col("low") + 1, F.col("high") - F.col("low") + needed)
    anchors = written(rarest.join(items, "item").select("item", "anchor", "term", "low", needed.alias("needed"), about.alias("about")), "anchors")
    aligned = (postings.join(anchors, "term")
               .select("doc", "item", "needed", "low", (F.col("position") - F.col("anchor")).alias("shift"), F.posexplode("about").alias("at", "term"))
               .select("doc", "item", "needed", "low", "shift", (F.col("shift") + F.col("low") + F.col("at")).alias("position"), "term")
               .join(postings, ["doc", "position", "term"]))
    line = W.partitionBy("doc", "item", "shift", "low").orderBy("position")
    found = (aligned.withColumn("island", F.col("position") - F.row_number().over(line))
             .groupBy("doc", "item", "shift", "low", "island")
             .agg(F.min("position").alias("first"), F.max("position").alias("last"), F.min("needed").alias("needed"))
             .where(F.col("last") - F.col("first") + 1 >= F.col("needed")))
    # what the anchors of one alignment found overlaps where it belongs together
    before = W.partitionBy("doc", "item", "shift").orderBy("first", "last")
    reach = F.max("last").over(before.rowsBetween(W.unboundedPreceding, -1))
    new = F.sum(F.when(F.col("first") <= F.col("reach") + 1, 0).otherwise(1)).over(before)
    return (found.withColumn("reach", reach).withColumn("run", new)
            .groupBy("doc", "item", "shift", "run").agg(F.min("first").alias("first"), F.max("last").alias("last"))
            .select("doc", "item", "first", "last"))


def proximity_matches(index: DataFrame, rare: DataFrame, band: int = BAND, terms: int = NEAR_WORDS) -> DataFrame:
    """(doc, item, n_terms): items of which ``terms`` rare words (item, place, term), or all it has if fewer, stand in the
    document at shifts that differ by less than ``band``; the index must be built with these words."""
    needed = rare.groupBy("item").agg(F.least(F.lit(terms), F.countDistinct("term")).alias("needed"))
    shift = F.col("position") - F.col("place")
    bands = F.explode(F.array(F.floor(shift / band), F.floor(shift / band) + 1)).alias("band")
    return (_exploded(index).join(rare, "term").select("doc", "item", "term", bands).distinct()
            .groupBy("doc", "item", "band").agg(F.count("*").alias("n_terms"))
            .groupBy("doc", "item").agg(F.max("n_terms").alias("n_terms"))
            .join(needed, "item").where("n_terms >= needed").select("doc", "item", "n_terms"))


def contamination(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", doc_text: str = "text",
                  item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, near: bool = False,
                  rarest: int = RARE_WORDS, together: int = NEAR_WORDS, band: int = BAND) -> DataFrame:
    """One row per document: (id, n_words, n_hit, n_items, items_sha256, contaminated), and with ``near`` n_near, the items
    (by id) that have a proximity match: ``together`` of their ``rarest`` words, within a ``band`` of shifts; these don't make a document contaminated."""
    items = item_words(items, item_id, item_text)
    rare = rare_words(docs, items, doc_text, rarest) if near else None
    index = build_index(docs, items, doc_id, doc_text, window, rare)
    runs = written(phrase_matches(index, items, window), "runs")
    before = W.partitionBy("doc").orderBy("first", "last").rowsBetween(W.unboundedPreceding, -1)
    reach = F.coalesce(F.max("last").over(before), F.lit(-1))
    hits = (runs.select("doc", "first", "last").distinct().withColumn("reach", reach)
            .groupBy("doc").agg(F.sum(F.greatest(F.lit(0), F.col("last") - F.greatest("first", F.col("reach") + 1) + 1)).alias("n_hit")))
    named = (runs.select("doc", "item").distinct().join(items.select("item", "item_id"), "item")
             .groupBy("doc").agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("ids")))
    found = hits.join(named, "doc")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("bigint")
    ids = F.coalesce("ids", F.array().cast("array<string>"))
    rows, more = index.select("doc", "id", "n_words").join(found, "doc", "left"), []
    if near:
        close = proximity_matches(index, rare, band, together).join(items.select("item", "item_id"), "item").groupBy("doc").agg(F.countDistinct("item_id").alias("n_near"))
        rows, more = rows.join(close, "doc", "left"), [F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near")]
    return (rows.select(F.col("id").alias(doc_id), "n_words", n_hit.alias("n_hit"), F.size(ids).cast("bigint").alias("n_items"),
                    F.sha2(F.array_join(ids, ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"), *more))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contamination of every document by every benchmark item, and how many items have words near each other in it."""
    return contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), near=True)


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP5_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT item_id, w, least({WINDOW}, len(w)) AS k FROM (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL) WHERE len(w) > 0),
iw AS (SELECT DISTINCT item_id, k, array_to_string(w[s + 1 : s + k], ' ') AS g FROM (SELECT item_id, w, k, unnest(range(0, len(w) - k + 1)) AS s FROM i)),
dw AS (SELECT r, s, k, array_to_string(w[s + 1 : s + k], ' ') AS g
       FROM (SELECT r, w, k, unnest(range(0, len(w) - k + 1)) AS s FROM d, (SELECT DISTINCT k FROM iw) WHERE len(w) >= k)),
m AS (SELECT r, s, dw.k AS k, item_id FROM dw JOIN iw ON dw.k = iw.k AND dw.g = iw.g),
h AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + k)) AS p FROM m) GROUP BY r),
t AS (SELECT r, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS x FROM m) GROUP BY r),
e AS (SELECT dense_rank() OVER (ORDER BY item_id, w) AS item, item_id, w FROM (SELECT DISTINCT item_id, w FROM i)),
q AS (SELECT item, item_id, unnest(w) AS g, unnest(range(0, len(w))) AS place FROM e),
dp AS (SELECT r, unnest(w) AS g, unnest(range(0, len(w))) AS position FROM d),
c AS (SELECT g, count(*) AS length FROM dp GROUP BY g),
rare AS (SELECT item, item_id, g, place FROM q JOIN (SELECT item, g FROM (SELECT item, g, min(place) AS first FROM q GROUP BY 1, 2) JOIN c USING (g) QUALIFY row_number() OVER (PARTITION BY item ORDER BY length, first) <= {RARE_WORDS}) USING (item, g)),
need AS (SELECT item, least({NEAR_WORDS}, count(DISTINCT g)) AS needed FROM rare GROUP BY item),
near AS (SELECT r, item, item_id, g, unnest([CAST(floor((position - place) / {BAND}) AS BIGINT), CAST(floor((position - place) / {BAND}) AS BIGINT) + 1]) AS band FROM dp JOIN rare USING (g)),
n AS (SELECT r, count(DISTINCT item_id) AS n_near FROM (SELECT r, item, item_id, band, count(DISTINCT g) AS k FROM near GROUP BY 1, 2, 3, 4) JOIN need USING (item) WHERE k >= needed GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near
FROM d LEFT JOIN h USING (r) LEFT JOIN t USING (r) LEFT JOIN n USING (r)
"""
