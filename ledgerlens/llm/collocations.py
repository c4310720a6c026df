"""Collocations: frequent contiguous phrases, mined by pivot partitioning and scored by their weakest cut.

Words are ordered by how often they occur in their language. A phrase belongs
to its rarest word, the pivot (to the first place where it stands in it). Every place
of a text is rewritten for its own word as pivot: up to four words on either
side, as far as they are not rarer (before it: more frequent) and frequent
enough to be in a phrase at all. These fragments are all that the pivot's
phrases need. They are counted where they lie, routed to the pivot, and mined there for
the phrases that hold the pivot's place: no other pivot has these phrases, so
only those that are frequent enough leave the task. Pivots of more than a part of a task's places are dealt to more
tasks by a hash of the fragment, and their sums are summed once more.

The HEAD most frequent words of all languages are broadcast with their places
in the order. Further frequent words, if there are any, come after them, in
code-point order; a broadcast bitmap of their hashes tells them from words that
are not frequent. A word that the bitmap takes for frequent by chance only
makes phrases that the final count drops.

A null text is empty; a null lang is `und`, like the lang of that name.
Repeated rows count as often as they occur. Ties of scores go to the more
frequent phrase, then to the smaller in UTF-8 byte order. A lang without
phrases, or an empty table, has no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerlens.llm.common import Scratch, sized_broadcast
from ledgerlens.llm.kernels import LOWER, P, mix, slices

#: The most words of a phrase, its least occurrences, and the percentage of a phrase's occurrences that a longer one needs to stand for it.
LONGEST, LEAST, COVERED, TOP = 5, 100, 100, 2000
#: Words broadcast with their order, the most bytes of one, and bits of the bitmap of further frequent words.
HEAD, HEAD_BYTES, FILTER_BITS = 400_000, 64, 26
#: Bits of the bitmap of pairs of words, and places whose pairs are counted at once.
PAIR_BITS, PAIRS = 26, 4_000_000
#: Distinct words that a task counts before it hands them on; texts rewritten at once; the places of a pivot from which on it may be, and is, dealt to more tasks.
COUNTED, TOGETHER, DEALT = 300_000, 4 << 20, (20_000, 2_000_000)
#: Fragments that are mined at once, if their pivots are complete.
MINED = 200_000
#: Fixed: bytes at which a text is split into pieces.
BREAKS = b".,;:!?\n\x0b\x0c\r"
_TABLE = bytes(ord(".") if b in BREAKS else c for b, c in enumerate(LOWER))


def tokens(text: bytes) -> list[bytes]:
    """The words of a text, A-Z lower-cased, with b"." between pieces."""
    return text.translate(_TABLE).replace(b".", b" . ").split()


def _by_lang(batch: pa.RecordBatch) -> Iterator[tuple[str, list[bytes]]]:
    """(lang, texts) of bounded parts of a batch."""
    for part, texts in slices(batch, "text", TOGETHER):
        own = defaultdict(list)
        for lang, text in zip(part.column("lang").to_pylist(), texts, strict=True):
            own[lang].append(text)
        yield from own.items()


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, word, n) of the words of all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, Counter[bytes]] = defaultdict(Counter)

        def handed() -> Iterator[pa.RecordBatch]:
            for lang, own in total.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(own), pa.string()), pa.array(list(own), pa.binary()).cast(pa.string()), pa.array(list(own.values()), pa.int64())], names=["lang", "word", "n"])
            total.clear()

        for batch in batches:
            for lang, texts in _by_lang(batch):
                for text in texts:
                    total[lang].update(tokens(text))
                    total[lang].pop(b".", None)
                if sum(map(len, total.values())) > COUNTED:
                    yield from handed()
        yield from handed()

    return docs.mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


class Order:
    """The order of words of all languages: places of the head, and a bitmap of the hashes of further frequent words, if any."""

    def __init__(self, head: dict[str, dict[bytes, int]], places: int, bitmap: np.ndarray | None):
        self.head, self.places, self.bitmap = head, places, bitmap

    @staticmethod
    def hash(lang: Column, word: Column) -> Column:
        return F.shiftright(F.crc32(F.concat(lang, F.lit(" "), word).cast("binary")), 32 - FILTER_BITS)

    def ranks(self, lang: str, words: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
        """Of each word its place, the most frequent first, -1 for breaks and words that aren't frequent; and the further words, by place."""
        own = self.head.get(lang, {})
        out = np.fromiter(map(own.get, words, repeat(-1)), np.int64, len(words))
        if self.bitmap is None:
            return out, []
        start = zlib.crc32(f"{lang} ".encode())
        known: dict[bytes, bool] = {b".": False}
        unsure = np.flatnonzero(out < 0).tolist()
        for i in unsure:
            w = words[i]
            if w not in known:
                h = zlib.crc32(w, start) >> 32 - FILTER_BITS
                known[w] = bool(self.bitmap[h >> 3] >> (h & 7) & 1)
        further = sorted(w for w, ok in known.items() if ok)
        at = {w: self.places + i for i, w in enumerate(further)}
        for i in unsure:
            out[i] = at.get(words[i], -1)
        return out, further


def word_order(frequent: DataFrame, head: int = HEAD) -> Order:
    """The order of frequent words (lang, word, n)."""
    short = F.octet_length("word") <= HEAD_BYTES
    top = frequent.where(short).orderBy(F.desc("n"), "lang", "word").limit(head).collect()  # bounded
    by: dict[str, dict[bytes, int]] = defaultdict(dict)
    for i, r in enumerate(top):
        by[r.lang][r.word.encode()] = i
    bitmap = None
    if frequent.count() > len(top):
        last = (-top[-1].n, top[-1].lang, top[-1].word) if top else (-(1 << 62), "", "")
        rest = frequent.where(~short | (F.struct(-F.col("n"), F.col("lang"), F.col("word")) > F.struct(F.lit(last[0]).cast("long"), F.lit(last[1]), F.lit(last[2]))))
        bits = rest.select(Order.hash(F.col("lang"), F.col("word")).alias("h")).groupBy((F.col("h") / 8).cast("long").alias("byte")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(h % 8 AS INT))")).alias("bits"))
        found = bits.toArrow()  # at most a row per byte of the bitmap
        bitmap = np.zeros(1 << FILTER_BITS - 3, np.uint8)
        bitmap[found["byte"].to_numpy()] = found["bits"].to_numpy()
    return Order(dict(by), len(top), bitmap)


def pair_hashes(lang: str, ranks: np.ndarray, further: list[bytes], places: int) -> np.ndarray:
    """A hash of every place's word and the next: of their places in the order, or of the words beyond it."""
    ids = ranks
    if further:
        ids, far = ranks.copy(), ranks >= places
        ids[far] = (np.array([zlib.crc32(w) for w in further], np.int64) + (1 << 40))[ranks[far] - places]
    own = np.uint64(zlib.crc32(lang.encode()) << 8)
    return (mix(ids[:-1].astype(np.uint64) + own) + mix(ids[1:].astype(np.uint64) ^ np.uint64(P))) * np.uint64(P) >> np.uint64(64 - PAIR_BITS)


def pair_filter(docs: DataFrame, order: Order, least: int) -> np.ndarray:
    """A bitmap of hashes of adjacent words that occur often enough together; hashes that others share may be set as well."""
    shared = docs.sparkSession.sparkContext.broadcast(order)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, found = shared.value, [np.zeros(0, np.uint64)]
        for batch in batches:
            for lang, texts in _by_lang(batch):
                ranks, further = own.ranks(lang, [w for text in texts for w in (*tokens(text), b".")])
                found.append(pair_hashes(lang, ranks, further, own.places)[(ranks[:-1] >= 0) & (ranks[1:] >= 0)])
                if sum(map(len, found)) > PAIRS:
                    yield handed(found)
        yield handed(found)

    def handed(found: list[np.ndarray]) -> pa.RecordBatch:
        pair, n = np.unique(np.concatenate(found), return_counts=True)
        found[:] = [np.zeros(0, np.uint64)]
        return pa.RecordBatch.from_arrays([pa.array(pair.astype(np.int32)), pa.array(n.astype(np.int32))], names=["pair", "n"])

    often = docs.mapInArrow(count, "pair int, n int").groupBy("pair").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    found = often.groupBy(F.expr("pair div 64").alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, pair % 64)")).alias("bits")).toArrow()  # at most 2**PAIR_BITS / 64 rows
    out = np.zeros(1 << PAIR_BITS - 6, np.int64)
    out[found["at"].to_numpy()] = found["bits"].to_numpy()
    return out.view(np.uint8)


def windows(ranks: np.ndarray, longest: int = LONGEST, linked: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """How many words before and behind each place its own word, as pivot, reaches: those before are more frequent, those behind not rarer, and each is linked to the next."""
    n, reach = len(ranks), longest - 1
    linked = np.ones(max(0, n - 1), bool) if linked is None else linked
    before, behind = np.zeros(n, np.int64), np.zeros(n, np.int64)
    open_before, open_behind = ranks >= 0, ranks >= 0
    for d in range(1, min(reach, n - 1) + 1):
        a, b = np.zeros(n, bool), np.zeros(n, bool)
        a[d:] = (ranks[:-d] >= 0) & (ranks[:-d] < ranks[d:]) & linked[: n - d]
        b[:-d] = (ranks[d:] >= 0) & (ranks[d:] <= ranks[:-d]) & linked[d - 1 :]
        open_before, open_behind = open_before & a, open_behind & b
        before += open_before
        behind += open_behind
    return before, behind


def distinct_rows(rows: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows without repeats, and the sum of times of each. Rows are grouped by a hash; those that share one without being equal stay as they are."""
    rng = np.random.default_rng(0)
    h = np.zeros(len(rows), np.uint64)
    for column, factor in zip(rows.T, rng.integers(1, 1 << 63, rows.shape[1], np.uint64)):
        h = (h ^ (column.astype(np.uint64) + np.uint64(2)) * factor) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    order = np.argsort(h)
    new = np.concatenate(([True], h[order[1:]] != h[order[:-1]]))
    first, of = order[new], np.cumsum(new) - 1
    same = (rows[first[of]] == rows[order]).all(axis=1)
    n = np.bincount(of[same], times[order[same]], len(first)).astype(np.int64)
    odd = order[~same]
    return np.concatenate((rows[first], rows[odd])), np.concatenate((n, times[odd]))


def fragments(docs: DataFrame, order: Order, pairs: np.ndarray, longest: int = LONGEST) -> DataFrame:
    """(lang, pivot, fragment, at, n): words around each pivot, space-joined, its place among them, and how often. pairs: of pair_filter()."""
    shared = docs.sparkSession.sparkContext.broadcast((order, pairs))
    reach = longest - 1

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, often = shared.value
        names: dict[str, pa.Array] = {}
        for batch in batches:
            for lang, texts in _by_lang(batch):
                words = [w for text in texts for w in (*tokens(text), b".")]
                ranks, further = own.ranks(lang, words)
                if lang not in names:
                    head = own.head.get(lang, {})
                    names[lang] = pa.array(list(head), pa.binary()).cast(pa.string()), np.array(list(head.values()), np.int64)
                pair = pair_hashes(lang, ranks, further, own.places)
                before, behind = windows(ranks, longest, (often[pair >> np.uint64(3)] >> (pair & np.uint64(7)).astype(np.uint8) & 1).astype(bool))
                at = np.flatnonzero(before + behind)
                if not len(at):
                    continue
                around = at[:, None] + np.arange(-reach, reach + 1)
                inside = (np.arange(-reach, reach + 1) >= -before[at][:, None]) & (np.arange(-reach, reach + 1) <= behind[at][:, None])
                rows, n = distinct_rows(np.where(inside, ranks[around.clip(0, len(ranks) - 1)], -1), np.ones(len(at), np.int64))
                filled = rows >= 0
                known, places = names[lang]
                text = pa.concat_arrays([known, pa.array(further, pa.binary()).cast(pa.string())])
                places = np.concatenate((places, own.places + np.arange(len(further))))
                size = filled.sum(axis=1)
                flat = text.take(pa.array(np.searchsorted(places, rows[filled])))
                joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(size))), pa.int32()), flat), " ")
                pivot = text.take(pa.array(np.searchsorted(places, rows[:, reach])))
                columns = [pa.array([lang], pa.string()).take(pa.array(np.zeros(len(rows), np.int64))), pivot, joined, pa.array(filled[:, :reach].sum(axis=1), pa.int64()), pa.array(n, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "pivot", "fragment", "at", "n"])

    return docs.mapInArrow(rewrite, "lang string, pivot string, fragment string, at long, n long")


def mine(fragment: pa.Array, at: np.ndarray, n: np.ndarray, group: np.ndarray, longest: int = LONGEST) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(group, phrase, occurrences) of the phrases in groups of fragments that hold their pivots' places."""
    parts = pc.split_pattern(fragment, " ")
    coded = parts.flatten().dictionary_encode()
    flat, start = coded.indices.to_numpy(), np.asarray(parts.offsets)
    size = np.diff(start)
    rows, times = [], []
    for l in range(longest):  # noqa: E741
        for r in range(longest - l):
            own = np.flatnonzero((at >= l) & (size > at + r)) if l + r else np.zeros(0, np.int64)
            if len(own):
                phrase = np.full((len(own), longest + 1), -1, np.int64)
                phrase[:, 0] = group[own]
                phrase[:, 1 : l + r + 2] = flat[(start[:-1] + at - l)[own, None] + np.arange(l + r + 1)]
                found, k = distinct_rows(phrase, n[own])
                rows.append(found)
                times.append(k)
    if not rows:
        return np.zeros(0, np.int64), pa.array([], pa.string()), np.zeros(0, np.int64)
    rows, times = np.concatenate(rows), np.concatenate(times)
    filled = rows[:, 1:] >= 0
    words = coded.dictionary.take(pa.array(rows[:, 1:][filled]))
    offsets = pa.array(np.concatenate(([0], np.cumsum(filled.sum(axis=1)))), pa.int32())
    return rows[:, 0], pc.binary_join(pa.ListArray.from_arrays(offsets, words), " "), times


def mined(routed: DataFrame, least: int, longest: int = LONGEST) -> DataFrame:
    """(lang, phrase, a, dealt) of fragments sorted by key: of a dealt pivot's part all phrases, of others those with least occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []

        def done(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            if not rows.num_rows:
                return
            lang = rows["lang"].combine_chunks().dictionary_encode()
            of = np.column_stack([rows["key"].to_numpy(), rows["dealt"].to_numpy().astype(np.int64), lang.indices.to_numpy()])
            group = np.cumsum(np.concatenate(([0], (of[1:] != of[:-1]).any(axis=1))))
            first = np.flatnonzero(np.concatenate(([True], np.diff(group) > 0)))
            found, phrase, n = mine(rows["fragment"].combine_chunks(), rows["at"].to_numpy().astype(np.int64), rows["n"].to_numpy(), group, longest)
            dealt = of[first[found], 1] == 1
            kept = np.flatnonzero((n >= least) | dealt)
            yield pa.RecordBatch.from_arrays([lang.dictionary.take(pa.array(of[first[found[kept]], 2])), phrase.take(pa.array(kept)), pa.array(n[kept]), pa.array(dealt[kept])], names=["lang", "phrase", "a", "dealt"])

        for batch in batches:
            waiting.append(batch)
            if sum(b.num_rows for b in waiting) >= MINED:
                rows = pa.Table.from_batches(waiting)
                key = rows["key"].to_numpy()
                cut = int(np.searchsorted(key, key[-1], "left"))  # the last key may go on
                yield from done(rows.slice(0, cut))
                waiting = rows.slice(cut).to_batches()
        if waiting:
            yield from done(pa.Table.from_batches(waiting))

    return routed.mapInArrow(run, "lang string, phrase string, a long, dealt boolean")


def phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, head: int = HEAD) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, a) of phrases of 2 to `longest` words with at least so many occurrences, and (lang, word, n) of all words."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "collocations")
    docs = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    words = scratch.keep(word_counts(docs), "words")
    frequent = words.where(F.col("n") >= least)
    order = word_order(frequent, head)
    found = fragments(docs, order, pair_filter(docs, order, least), longest)
    # Pivots of over a quarter of a task's places are dealt to as many tasks as they need.
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = min(max(DEALT[0], (words.agg(F.sum("n")).first()[0] or 0) // (4 * tasks)), DEALT[1])
    hot = scratch.keep(words.where(F.col("n") > dealt).select(F.col("lang").alias("__lang"), F.col("word").alias("__word"), F.ceil(F.col("n") / dealt).cast("long").alias("__tasks")), "hot")
    found = found.join(sized_broadcast(hot, hot.count()), (F.col("lang") == F.col("__lang")) & (F.col("pivot") == F.col("__word")), "left")
    part = F.coalesce(F.pmod(F.xxhash64("fragment"), F.col("__tasks")), F.lit(-1).cast("long"))
    routed = found.select("lang", F.hash("pivot", part).alias("key"), F.col("__tasks").isNotNull().alias("dealt"), "fragment", F.col("at").cast("byte").alias("at"), "n")
    routed = routed.repartition("key").sortWithinPartitions("key", "dealt", "lang")
    own = scratch.keep(mined(routed, least, longest), "mined")
    again = own.where("dealt").groupBy("lang", "phrase").agg(F.sum("a").alias("a")).where(F.col("a") >= least)
    return own.where("not dealt").select("lang", "phrase", "a").unionByName(again), words


def _wide(c: str) -> Column:
    return F.col(c).cast("decimal(16,0)")


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, covered: int = COVERED, top: int = TOP, head: int = HEAD) -> DataFrame:
    """Each lang's best phrases: lang, rank, phrase, a, l, r, n, score."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "scores")
    found, words = phrases(docs, least, longest, head)
    found = scratch.keep(found, "phrases")
    totals = scratch.keep(words.groupBy("lang").agg(F.sum("n").alias("n")), "totals")
    counts = found.select("lang", F.col("phrase").alias("part"), F.col("a").alias("f")).unionByName(words.where(F.col("n") >= least).select("lang", F.col("word").alias("part"), F.col("n").alias("f")))
    split = found.withColumn("words", F.split("phrase", " "))
    # Longer phrases that stand for the shorter ones inside them.
    size = F.size("words")
    inner = F.expr(f"flatten(transform(sequence(2, size(words) - 1), k -> transform(sequence(1, size(words) - k + 1), s -> array_join(slice(words, s, k), ' '))))")
    longer = split.where(size > 2).select("lang", F.explode(inner).alias("phrase"), F.col("a").alias("over")).groupBy("lang", "phrase").agg(F.max("over").alias("over"))
    own = split.join(longer, ["lang", "phrase"], "left").where(F.col("over").isNull() | (100 * F.col("over") < covered * F.col("a")))
    cuts = own.select("lang", "phrase", "a", F.explode(F.expr("transform(sequence(1, size(words) - 1), k -> struct(k, array_join(slice(words, 1, k), ' ') AS first, array_join(slice(words, k + 1, size(words)), ' ') AS rest))")).alias("cut"))
    cuts = cuts.select("lang", "phrase", "a", F.col("cut.k").alias("k"), F.col("cut.first").alias("first"), F.col("cut.rest").alias("rest"))
    cuts = cuts.join(counts.select("lang", F.col("part").alias("first"), F.col("f").alias("l")), ["lang", "first"]).join(counts.select("lang", F.col("part").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    cuts = cuts.join(sized_broadcast(totals, totals.count()), "lang")
    score = (F.lit(1000).cast("decimal(4,0)") * _wide("a") * _wide("n")).alias("top"), (_wide("l") * _wide("r")).alias("bottom")
    cuts = cuts.select("lang", "phrase", "a", "k", "l", "r", "n", *score).withColumn("score", F.expr("top div bottom"))
    weakest = cuts.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("cut"))
    scored = weakest.select("lang", "phrase", *[F.col(f"cut.{c}").alias(c) for c in ("a", "l", "r", "n", "score")])
    by = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    some = scored.withColumn("deal", F.pmod(F.xxhash64("phrase"), F.lit(256))).withColumn("rank", F.row_number().over(W.partitionBy("lang", "deal").orderBy(*by))).where(F.col("rank") <= top)
    ranked = some.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*by)).cast("long")).where(F.col("rank") <= top)  # of at most 256 * top rows a lang
    return scratch.keep(ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score"), "best")
