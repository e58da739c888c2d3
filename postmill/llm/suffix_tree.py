"""LM scoring by a probabilistic suffix tree over words.

Contexts of one word up to ``DEPTH`` are counted level by level over all training documents. A
run of words is counted only where the runs it is made of were frequent enough: its context (all
but the last word) ``LEAST_CONTEXT`` times, its suffix (all but the first) ``LEAST_COUNT`` times.
Both are known from the level before and reach the counting pass as bit sets, sized by their keys; a
false positive of a set only counts a run too many, which the exact joins after it drop.

A context is retained where its next-word distribution diverges from that of its suffix: the
likelihood gained on its occurrences, in decimal digits, must be ``DIGITS`` or more for every
next word it keeps, whatever the size of the corpus. Distributions are smoothed by absolute
discounting, the discounted mass going to the suffix's distribution, down to the add-one unigram;
each sums to one over the known words and one unknown one. A text is scored by the longest
retained suffix at each place.

Neither the tree nor the words have a bound. The ``HOT_WORDS`` most frequent words and the
``HOT_NODES`` most frequent nodes are broadcast (a node is a run of words, with its probability as
an entry and what it leaves to its suffix as a context). Counts of other words are looked up by a
join. What the other nodes say are the cold facts, one each for an entry and a context. A Bloom
filter of them is broadcast, and what it lets through of the texts to be scored, though there is no
such fact, is told apart by a join before. So a place's terms are known for sure, and a text asks
for its sum of terms by the different facts in it, not place by place; scores do not depend on what
is broadcast.

Runs are told apart by 64-bit hashes. Null texts count as empty (an end only). Repeated rows are
scored, and counted in training, one by one. Rows with a null id are training rows. With no
training documents every count is zero. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import lists, text_batches, written
from .tokens import BLANKS, hash_words, mix

END = np.uint64(0x5851F42D4C957F2D)
_LEAVES = np.uint64(0xD1B54A32D192ED03)
DEPTH = 2
DISCOUNT = 0.75
LEAST_COUNT = 4
LEAST_CONTEXT = 16
DIGITS = 1.0
#: Words (16 bytes each) and nodes of the tree (16 bytes each) that are broadcast.
HOT_WORDS, HOT_NODES = 1 << 20, 1 << 22
#: Bits of a broadcast set of keys for each key, and of a whole one at least and at most (128 MB, which is enough for 2^26 keys; with more
#: of them, more of what is no key is let through); and how many bits a key of a Bloom filter has.
KEY_BITS, LEAST_BITS, MOST_BITS, PROBES = 16, 1 << 20, 1 << 30, 4
#: What a Bloom filter lets through in vain is listed up to so many keys (8 bytes each), and beyond that by a filter of its own.
MOST_LISTED = 1 << 22
#: Bits of the set of broadcast nodes' or words' keys.
HOT_BITS = 1 << 26
_HELD = 1 << 21
_CHUNK = 1 << 18


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(7)) == 2, F.lit(False))


# ---- words and runs ---------------------------------------------------------------------------


def _tokens(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes with an end after each row, and row offsets."""
    words, rows = hash_words(col, BLANKS)
    n = len(rows) - 1
    offsets = rows + np.arange(n + 1)
    out = np.empty(len(words) + n, np.uint64)
    last = np.zeros(len(out), bool)
    last[offsets[1:] - 1] = True
    out[~last] = words
    out[last] = END
    return out, offsets


def run_key(context: np.ndarray, suffix: np.ndarray) -> np.ndarray:
    """Key of the run that begins with ``context`` and ends with ``suffix``, one word shorter each."""
    return mix(mix(context) + suffix)


def _before(values: np.ndarray, none) -> np.ndarray:
    """Each place's value one place earlier."""
    return np.concatenate([np.array([none], values.dtype), values[:-1]])


def _runs(words: np.ndarray, offsets: np.ndarray, depth: int):
    """Level by level, from 0: (level, context, suffix, run, there) at each place; ``there``: is the row that long."""
    place = np.arange(len(words)) - np.repeat(offsets[:-1], np.diff(offsets))
    run = words
    yield 0, None, None, run, np.ones(len(words), bool)
    for level in range(1, depth + 1):
        context, suffix = _before(run, 0), run
        run = run_key(context, suffix)
        yield level, context, suffix, run, place >= level


def _slot(keys: np.ndarray, bits: int, probe: int = 0) -> np.ndarray:
    return (keys * np.uint64(0x9E3779B97F4A7C15 + 2 * probe * 0x632BE59BD9B4E019 & 0xFFFFFFFFFFFFFFFF)) >> np.uint64(65 - bits.bit_length())  # the upper bits


def _in(packed: np.ndarray, keys: np.ndarray, probe: int = 0) -> np.ndarray:
    slot = _slot(keys, 8 * len(packed), probe)
    return (packed[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & np.uint8(1) > 0


def _in_all(packed: np.ndarray, keys: np.ndarray, probes: int = PROBES) -> np.ndarray:
    out = _in(packed, keys)
    for probe in range(1, probes):
        at = np.flatnonzero(out)
        out[at] = _in(packed, keys[at], probe)
    return out


def _bit_set(keys: DataFrame, probes: int = 1) -> np.ndarray:
    """Bits of the keys' slots, as many as the keys need; at most MOST_BITS / 64 rows reach the driver, whatever their number."""
    bits = min(max(1 << (KEY_BITS * keys.count()).bit_length(), LEAST_BITS), MOST_BITS)

    def slots(batches):
        with np.errstate(over="ignore"):
            for batch in batches:
                found = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
                for probe in range(probes):
                    yield pa.RecordBatch.from_arrays([pa.array(_slot(found, bits, probe).astype(np.int64))], names=["slot"])

    rows = (keys.mapInArrow(slots, "slot bigint")
            .select(F.shiftright("slot", 6).alias("at"), F.expr("shiftleft(1L, int(slot & 63))").alias("bit"))
            .groupBy("at").agg(F.bit_or("bit").alias("bit"))).toArrow()
    words = np.zeros(bits // 64, np.uint64)
    words[rows["at"].to_numpy()] = rows["bit"].to_numpy().view(np.uint64)
    return words.view(np.uint8)


class _Apart:
    """Which of the keys that a Bloom filter lets through are none: by filters that each hold what the one before lets through in vain, and a list at the end."""

    def __init__(self, tried: DataFrame, most: int):
        """``tried``: each key let through once, and whether it is ``there``."""
        wrong, right = tried.where("not there").select("key"), tried.where("there").select("key")
        self.filters, n, before = [], wrong.count(), None
        while n > most and (before is None or n < before):
            self.filters.append(_bit_set(wrong, PROBES))
            wrong, right, before = right.mapInArrow(_let_through(self.filters[-1]), "key bigint"), wrong, n
            n = wrong.count()
        self.last = np.sort(wrong.toArrow()["key"].to_numpy().view(np.uint64))

    def there(self, keys: np.ndarray) -> np.ndarray:
        out, at, yes = np.ones(len(keys), bool), np.arange(len(keys)), True
        for packed in self.filters:
            at, yes = at[_in_all(packed, keys[at])], not yes
            out[at] = yes
        if len(self.last):
            near = self.last[np.minimum(np.searchsorted(self.last, keys[at]), len(self.last) - 1)]
            out[at[near == keys[at]]] = not yes
        return out


def _let_through(packed: np.ndarray):
    def apply(batches):
        with np.errstate(over="ignore"):
            for batch in batches:
                keys = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array(keys[_in_all(packed, keys)].view(np.int64))], names=["key"])

    return apply


# ---- counts -----------------------------------------------------------------------------------


def _word_counts(batches):
    """Partial counts of words: (key, n)."""
    held, size = [], 0

    def counted():
        keys, n = np.unique(np.concatenate(held), return_counts=True)
        for k in range(0, len(n), _CHUNK):
            yield pa.RecordBatch.from_arrays([pa.array(keys[k : k + _CHUNK].view(np.int64)), pa.array(n[k : k + _CHUNK])], names=["key", "n"])

    with np.errstate(over="ignore"):
        for batch in batches:
            held.append(_tokens(batch.column(0))[0])
            size += len(held[-1])
            if size >= _HELD:
                yield from counted()
                held, size = [], 0
        if held:
            yield from counted()


def _run_counts(level: int, contexts: Broadcast, suffixes: Broadcast):
    """Partial counts of runs of ``level`` + 1 words whose context and suffix are in the sets: (context, suffix, n)."""

    def counted(held):
        context, suffix = (np.concatenate(x) for x in zip(*held))
        _, first, n = np.unique(run_key(context, suffix), return_index=True, return_counts=True)
        for k in range(0, len(n), _CHUNK):
            at = first[k : k + _CHUNK]
            yield pa.RecordBatch.from_arrays([pa.array(context[at].view(np.int64)), pa.array(suffix[at].view(np.int64)), pa.array(n[k : k + _CHUNK])], names=["context", "suffix", "n"])

    def apply(batches):
        held, size = [], 0
        with np.errstate(over="ignore"):
            for batch in batches:
                *_, (_, context, suffix, _, there) = _runs(*_tokens(batch.column(0)), level)
                at = np.flatnonzero(there)
                at = at[_in(contexts.value, context[at])]
                at = at[_in(suffixes.value, suffix[at])]
                held.append((context[at], suffix[at]))
                size += len(at)
                if size >= _HELD:
                    yield from counted(held)
                    held, size = [], 0
            if held:
                yield from counted(held)

    return apply


def _keyed(batches):
    """(context, suffix, …) with the run's key first."""
    with np.errstate(over="ignore"):
        for batch in batches:
            context, suffix = (batch.column(k).to_numpy(zero_copy_only=False).view(np.uint64) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(run_key(context, suffix).view(np.int64)), batch.column(0), *batch.columns[2:]], names=["key", "context", *batch.schema.names[2:]])


def _level(texts: DataFrame, shorter: DataFrame, level: int, least_count: int, least_context: int, digits: float) -> tuple[DataFrame, DataFrame]:
    """Runs (key, n, p, lp) of a level, and its retained contexts (key, n, esc), from the ``shorter`` runs (key, n, p).

    ``p``: probability of the run's last word by the longest retained suffix of its context; ``lp``: its logarithm where
    that is the whole context; ``esc``: logarithm of what a context leaves to its suffix."""
    sc = texts.sparkSession.sparkContext
    sets = [sc.broadcast(_bit_set(shorter.where(F.col("n") >= least).select("key"))) for least in (least_context, least_count)]
    counts = (texts.mapInArrow(_run_counts(level, *sets), "context bigint, suffix bigint, n bigint")
              .groupBy("context", "suffix").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count))
    contexts = shorter.where(F.col("n") >= least_context).select(F.col("key").alias("context"), F.col("n").alias("n_context"))
    suffixes = shorter.select(F.col("key").alias("suffix"), F.col("p").alias("p_suffix"))
    runs = written(counts.join(contexts, "context").join(suffixes, "suffix").select("context", "suffix", "n", "n_context", "p_suffix")
                   .mapInArrow(_keyed, "key bigint, context bigint, n bigint, n_context bigint, p_suffix double"), "runs")
    for s in sets:
        s.destroy()
    # Tables on both sides of a join by context let Spark split a hot one.
    unseen = F.first("n_context") - F.sum("n")
    totals = written(runs.groupBy("context").agg(F.first("n_context").alias("n_context"), unseen.alias("unseen"), F.count("*").alias("kept"))
                     .withColumn("escape", (F.col("unseen") + DISCOUNT * F.col("kept")) / F.col("n_context")), "totals")
    p = (F.col("n") - DISCOUNT) / F.col("n_context") + F.col("escape") * F.col("p_suffix")
    gain = (runs.join(totals.select("context", "escape"), "context").groupBy("context")
            .agg(F.sum(F.col("n") * F.log10(p / F.col("p_suffix"))).alias("gain")))
    worth = F.col("gain") + F.col("unseen") * F.log10("escape") >= digits * F.col("kept")
    retained = written(totals.join(gain, "context").where(worth).select("context", "n_context", "escape"), "retained")
    known = written(runs.join(retained.select("context", "escape"), "context", "left").withColumn("own", p)
                    .select("key", "n", F.coalesce("own", "p_suffix").alias("p"), F.log10("own").alias("lp")), "known")
    return known, retained.select(F.col("context").alias("key"), F.col("n_context").alias("n"), F.log10("escape").alias("esc"))


# ---- the tree ---------------------------------------------------------------------------------


class _Hot:
    """Rows by their key. Keys are hashes, so that their first bits tell about where a key stands: a search looks at one or two."""

    def __init__(self, rows: DataFrame, names: list[str]):
        # sorted as unsigned numbers, by Spark, to spare the driver a copy
        found = rows.select("key", *names).orderBy(F.col("key").bitwiseXOR(F.lit(-(1 << 63)))).toArrow()
        self.keys, self.columns, self.begins = found["key"].to_numpy().view(np.uint64), [found[n].to_numpy() for n in names], None

    def _prepare(self) -> None:
        self.shift = np.uint64(64 - max(1, int(np.log2(max(2, len(self.keys))))))
        heads = (self.keys >> self.shift).astype(np.int64)
        self.begins = np.searchsorted(heads, np.arange((1 << (64 - int(self.shift))) + 1)).astype(np.int32)
        self.most = int(np.diff(self.begins).max(initial=0))
        bits = np.zeros(HOT_BITS, bool)
        bits[_slot(self.keys, HOT_BITS)] = True
        self.bits = np.packbits(bits, bitorder="little")

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Positions of the keys that are there, and the columns' values for them."""
        if self.begins is None:
            self._prepare()
        left = np.flatnonzero(_in(self.bits, keys))
        head = (keys[left] >> self.shift).astype(np.int64)
        at, end = self.begins[head], self.begins[head + 1]
        hits, places = [], []
        for _ in range(self.most):
            some = at < end
            left, at, end = left[some], at[some], end[some]
            if not len(left):
                break
            hit = self.keys[at] == keys[left]
            hits.append(left[hit])
            places.append(at[hit])
            left, at, end = left[~hit], at[~hit] + 1, end[~hit]
        if not hits:
            return np.empty(0, np.int64), [c[:0] for c in self.columns]
        places = np.concatenate(places)
        return np.concatenate(hits), [c[places] for c in self.columns]


def _most_frequent(rows: DataFrame, most: int) -> tuple[DataFrame, DataFrame | None]:
    """Rows (…, n) cut in two at the smallest count of which no more than ``most`` have as much; None where nothing is left."""
    cut, room = None, most
    for r in rows.groupBy(F.floor(F.log2("n") * 8).alias("step")).agg(F.count("*").alias("rows"), F.min("n").alias("least")).orderBy(F.desc("step")).collect():
        room -= r["rows"]
        if room < 0:
            break
        cut = r["least"]
    if room >= 0:
        return rows, None
    return (rows.limit(0), rows) if cut is None else (rows.where(F.col("n") >= cut), rows.where(F.col("n") < cut))


def _leaves(keys: np.ndarray) -> np.ndarray:
    """Keys of the facts what contexts leave; an entry's fact has the key of its run."""
    return mix(keys + _LEAVES)


def _facts(batches):
    """(key, fact) of nodes (key, lp, esc): one for each that is not null."""
    with np.errstate(over="ignore"):
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for column, of in ((1, lambda k: k), (2, _leaves)):
                there = batch.column(column).is_valid()
                found = of(keys[there.to_numpy(zero_copy_only=False)])
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), batch.column(column).filter(there)], names=["key", "fact"])


class SuffixTree:
    """A fitted tree: hot words and nodes as one broadcast, all words as a table (key, n), what the other nodes say as a table (key, fact) or None."""

    def __init__(self, hot: Broadcast, words: DataFrame, cold: DataFrame | None, depth: int, total: int, distinct: int):
        self.hot, self.words, self.cold, self.depth, self.total = hot, words, cold, depth, total
        #: what counts are divided by, once one is added
        self.scale = float(total + distinct + 1)


def fit(training: DataFrame, text_col: str = "text", depth: int = DEPTH, least_count: int = LEAST_COUNT, least_context: int = LEAST_CONTEXT,
        digits: float = DIGITS, hot_words: int = HOT_WORDS, hot_nodes: int = HOT_NODES) -> SuffixTree:
    """Fit on every row of ``training``; contexts of up to ``depth`` words."""
    spark = training.sparkSession
    text_batches(spark, 256)
    texts = training.select(F.col(text_col).cast("string").alias("text"))
    words = written(texts.mapInArrow(_word_counts, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n")), "words")
    total, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    shorter = words.where(F.col("n") >= least_count).withColumn("p", (F.col("n") + 1) / F.lit(float(total + distinct + 1)))
    none, nodes = F.lit(None).cast("double"), None
    for level in range(1, depth + 1):
        shorter, contexts = _level(texts, shorter, level, least_count, least_context, digits)
        both = shorter.where("lp is not null").select("key", "n", "lp", none.alias("esc")).unionByName(contexts.withColumn("lp", none))
        nodes = both if nodes is None else nodes.unionByName(both)
    nodes = written(nodes.groupBy("key").agg(F.max("n").alias("n"), F.max("lp").cast("float").alias("lp"), F.max("esc").cast("float").alias("esc")), "nodes")
    hot, cold = _most_frequent(nodes, hot_nodes)
    if cold is not None:
        cold = written(cold.select("key", "lp", "esc").mapInArrow(_facts, "key bigint, fact float"), "facts")
    model = {"words": _Hot(_most_frequent(words, hot_words)[0], ["n"]), "nodes": _Hot(hot, ["lp", "esc"]),
             "cold": None if cold is None else _bit_set(cold.select("key"), PROBES)}
    return SuffixTree(spark.sparkContext.broadcast(model), words, cold, depth, total, distinct)


# ---- scores -----------------------------------------------------------------------------------


_NAMES = ["row", "id", "held_out", "n_tokens", "known", "base", "value", "cold", "times", "low_times", "asks", "ask_times"]


def _terms(m: dict, apart: _Apart | None, words: np.ndarray, offsets: np.ndarray, depth: int, base: np.ndarray):
    """Of each place: the sum of its known terms, whether the word's own is among its terms, and keys of its terms that are cold facts (0: none), a row for each
    kind of term; then keys of all facts that some place may need. Without ``apart`` the filter alone tells which facts there are."""

    def cold(keys: np.ndarray, of: np.ndarray, out: np.ndarray) -> np.ndarray:
        """The keys where there is a cold fact of them."""
        hit = _in_all(m["cold"], keys)
        if apart is not None:
            some = np.flatnonzero(hit)
            hit[some] = apart.there(keys[some])
        out[of[hit]] = keys[hit]
        needed.append(keys[hit])
        return out

    n, needed = len(words), []
    none = lambda: np.zeros(n, np.uint64)
    value, low, terms = base.copy(), np.ones(n, bool), [none()]
    esc, left = np.full(n, np.nan), none()
    for level, _, _, run, there in _runs(words, offsets, depth):
        own, ask = _before(esc, np.nan), _before(left, 0)
        own[~there], ask[~there] = np.nan, 0
        kept = ~np.isnan(own) | (ask > 0) if level else there
        at = np.flatnonzero(there if level < depth else kept)  # a run is looked up where its context is there, or as a context itself
        lp, esc = np.full(n, np.nan), np.full(n, np.nan)
        found, (a, b) = m["nodes"].get(run[at])
        lp[at[found]], esc[at[found]] = a, b
        said, left = none(), none()
        if m["cold"] is not None:
            other = np.ones(len(at), bool)
            other[found] = False
            at = at[other]
            if level < depth:
                left = cold(_leaves(run[at]), at, left)
            if level:
                at = at[kept[at]]
                said = cold(run[at], at, said)
        if level:
            hit = kept & (~np.isnan(lp) | (said > 0))
            value = np.where(hit, np.nan_to_num(lp), np.where(kept, np.nan_to_num(own) + value, value))
            low &= ~hit
            for x in terms:
                x[hit] = 0
            terms[0][hit] = said[hit]
            terms.append(np.where(kept & ~hit, ask, np.uint64(0)))
    return value, low, np.stack(terms), needed


def _needed(hot: Broadcast, depth: int):
    """Keys of cold facts that the filter lets through, each once in so many words."""

    def told(held):
        keys = np.unique(np.concatenate(held))
        for k in range(0, len(keys), _CHUNK):
            yield pa.RecordBatch.from_arrays([pa.array(keys[k : k + _CHUNK].view(np.int64))], names=["key"])

    def apply(batches):
        held, size = [], 0
        with np.errstate(over="ignore"):
            for batch in batches:
                words, offsets = _tokens(batch.column(0))
                held += _terms(hot.value, None, words, offsets, depth, np.zeros(len(words)))[3]
                size += len(words)
                if size >= _HELD:
                    yield from told(held)
                    held, size = [], 0
            if held:
                yield from told(held)

    return apply


def _in_rows(row: np.ndarray, keys: np.ndarray, rows: int, *weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """The different keys of each row, where each row's begin, and their sums of weights."""
    order = np.lexsort((keys, row))
    row, keys = row[order], keys[order]
    first = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (keys[1:] != keys[:-1])])[: len(keys)])
    sums = [np.add.reduceat(w[order], first) if len(first) else w[:0] for w in weights]
    return keys[first], np.searchsorted(row[first], np.arange(rows + 1)), sums


def _score(hot: Broadcast, apart: Broadcast | None, depth: int, scale: float):
    """One row per text: the sums of what is known, its other words and the cold facts that it asks for."""

    def apply(batches):
        m, sure = hot.value, None if apart is None else apart.value
        for batch in batches:
            with np.errstate(over="ignore"):
                words, offsets = _tokens(batch.column(3))
                rows = len(offsets) - 1
                row = np.repeat(np.arange(rows), np.diff(offsets))
                different, where = np.unique(words, return_inverse=True)
                found, (counts,) = m["words"].get(different)
                known, log = np.zeros(len(different), bool), np.zeros(len(different))
                known[found], log[found] = True, np.log10((counts + 1) / scale)
                heard, base = known[where], log[where]
                value, low, terms, _ = _terms(m, sure, words, offsets, depth, base)
                per = lambda x: np.bincount(row, weights=x, minlength=rows)  # noqa: B023, E731
                # what is left of the words: distinct ones of each text, all their times and those that count for the score
                cold = np.flatnonzero(~heard)
                others, others_end, (times, low_times) = _in_rows(row[cold], words[cold], rows, np.ones(len(cold), np.int32), low[cold].astype(np.int32))
                _, place = np.nonzero(terms)
                asks, asks_end, (ask_times,) = _in_rows(row[place], terms[terms > 0], rows, np.ones(len(place), np.int32))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), batch.column(2), pa.array(np.diff(offsets)), pa.array(per(heard).astype(np.int64)), pa.array(per(base)), pa.array(per(value)),
                     lists(others.view(np.int64), others_end, pa.int64()), lists(times, others_end, pa.int32()), lists(low_times, others_end, pa.int32()),
                     lists(asks.view(np.int64), asks_end, pa.int64()), lists(ask_times, asks_end, pa.int32())], names=_NAMES)

    return apply


def _word_log(count: Column, scale: float) -> Column:
    return F.log10((F.coalesce(count, F.lit(0)) + 1) / F.lit(scale))


def _told_apart(texts: DataFrame, tree: SuffixTree) -> Broadcast:
    """Which of the cold facts that the texts may need there are."""
    there = tree.cold.select("key", F.lit(True).alias("there"))
    asked = texts.mapInArrow(_needed(tree.hot, tree.depth), "key bigint").distinct()
    tried = written(asked.join(there, "key", "left").select("key", F.coalesce("there", F.lit(False)).alias("there")), "tried")
    return texts.sparkSession.sparkContext.broadcast(_Apart(tried, MOST_LISTED))


def score(docs: DataFrame, tree: SuffixTree, id_col: str = "doc_id", text_col: str = "text", held: Column | None = None) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) per row."""
    text_batches(docs.sparkSession, 256)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), (F.lit(False) if held is None else held).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    apart = None if tree.cold is None else _told_apart(rows.select("text"), tree)
    found = written(rows.mapInArrow(_score(tree.hot, apart, tree.depth, tree.scale),
                                    f"row bigint, id {kind}, held_out boolean, n_tokens bigint, known bigint, base double, value double, cold array<bigint>, times array<int>, low_times array<int>, "
                                    "asks array<bigint>, ask_times array<int>"), "scored")
    scored = found.select("row", "id", "held_out", "n_tokens", "known", "base", "value")
    part, zero = _word_log(F.col("n"), tree.scale), F.lit(0)
    cold = (found.select("row", F.inline(F.arrays_zip("cold", "times", "low_times"))).join(tree.words.withColumnRenamed("key", "cold"), "cold", "left").groupBy("row")
            .agg(F.sum(F.col("times") * part).alias("cold_base"), F.sum(F.col("low_times") * part).alias("cold_value"), F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("cold_known")))
    scored = scored.join(cold, "row", "left").withColumns({f"{c}": F.col(c) + F.coalesce(f"cold_{c}", zero) for c in ("known", "base", "value")})
    if tree.cold is not None:
        # a fact that was there when texts were searched for what they need is there now; else a text has changed meanwhile
        fact = F.coalesce(F.col("fact").cast("double"), F.raise_error(F.lit("a text asks for a node that there is not")).cast("double"))
        asks = found.select("row", F.inline(F.arrays_zip("asks", "ask_times"))).join(tree.cold.withColumnRenamed("key", "asks"), "asks", "left")
        more = asks.groupBy("row").agg(F.sum(F.col("ask_times") * fact).alias("more_value"))
        scored = scored.join(more, "row", "left").withColumn("value", F.col("value") + F.coalesce("more_value", zero))
    return scored.select(
        F.col("id").alias(id_col), "held_out", "n_tokens", F.col("known").cast("bigint").alias("n_known"), F.lit(tree.total).cast("bigint").alias("train_tokens"),
        F.round("base", 6).alias("base_score"), F.round("value", 6).alias("score"))


def op3_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log10 probability of every document under the unigram base and under the tree, learnt from the documents not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = held_out(F.col("doc_id"))
    return score(docs, fit(docs.where(~held)), held=held)
