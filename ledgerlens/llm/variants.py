"""Spelling variants: groups of words that differ by one code point, found by a rare-first prefix filter of positional bigrams.

One edit destroys at most two of a word's bigrams, so of the three rarest of
one word at least one survives in the other, and as all words order bigrams
alike, it is among the other's three rarest too, if bigrams that equal the
third are all taken. Around a bigram that survives, the edit is wholly on its
right or wholly on its left, so the two words agree on all code points up to
and with it, or from it on: that is the position limit, and the key of the
join. Where that is short, a half of the other side, which the edit leaves
alone too, is part of the key. Joined pairs are verified by edit distance.

Bigrams are ordered by how many words have them; the HEAD most frequent are
broadcast with their places, all others are rarer and ordered by code points.
Each form of a chain counts `ratio` times as often as the one before, so
chains are short; they are followed by doubling.

Null texts have no words, null ids are the empty string in the hash that spoils
words. Repeated rows count as often as they occur. Ties of the largest n go to
the smallest word. Empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import Scratch
from ledgerlens.llm.kernels import LOWER, slices

#: Fixed: letters of a word.
LETTERS = r"[A-Za-zÀ-ÿ]"
LEAST_LENGTH, LEAST_COUNT, RATIO, SPOIL = 7, 2, 10, 31
RAREST = 3
#: Code points of an unedited side that many words share.
WEAK = 5
#: Bigrams that are broadcast with their places in the order.
HEAD = 100_000
#: Distinct words that a task counts before it hands them on.
COUNTED = 300_000


def dictionary(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, spoil: int | None = None, id_col: str = "doc_id") -> DataFrame:
    """(word, n) of the words of whole texts, A-Z lower-cased, that are long and frequent enough.

    spoil: every so manieth word of a document, by a hash, loses one code point, for tests of what finds variants.
    """
    runs = re.compile(f"{LETTERS}{{{least_length},}}")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()

        def handed() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])
            total.clear()
            return out

        for batch in batches:
            for part, texts in slices(batch, "text"):
                for name, text in zip(part.column("__id").to_pylist(), texts, strict=True):
                    found = runs.findall(text.translate(LOWER).decode())
                    if not spoil:
                        total.update(found)
                    else:
                        start = zlib.crc32(f"{name or ''}:".encode())
                        for word, n in Counter(found).items():
                            h = zlib.crc32(word.encode(), start)
                            if h % spoil == 0:
                                at = h % len(word)
                                word = word[:at] + word[at + 1 :]
                                if len(word) < least_length:
                                    continue
                            total[word] += n
                    if len(total) > COUNTED:
                        yield handed()
        yield handed()

    found = docs.select(F.col(id_col).cast("string").alias("__id"), "text").mapInArrow(count, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def gram_order(words: DataFrame) -> dict[str, int]:
    """The places of the HEAD most frequent bigrams, the rarest first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()
        for batch in batches:
            for w in batch.column("word").to_pylist():
                total.update(map(str.__add__, w, w[1:]))
            if len(total) > COUNTED:
                yield pa.RecordBatch.from_pydict({"gram": list(total), "n": list(total.values())})
                total.clear()
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["gram", "n"])

    top = words.select("word").mapInArrow(count, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "gram").limit(HEAD).collect()
    return {r.gram: i for i, r in enumerate(reversed(top))}


def rare_places(word: str, order: dict[str, int], rarest: int = RAREST) -> list[int]:
    """Where the rarest bigrams of a word begin, with all that equal the last of them."""
    grams = [word[i : i + 2] for i in range(len(word) - 1)]
    ranked = sorted((order.get(g, -1), g, i) for i, g in enumerate(grams))
    last = ranked[min(rarest, len(ranked)) - 1][:2]
    return [i for o, g, i in ranked if (o, g) <= last]


def halves(rest: str, length: int) -> tuple[str, str]:
    """What is left of the two halves of a text of a length, if rest is that text or has one code point more."""
    return f"a{rest[: length // 2]}", f"b{rest[len(rest) - (length - length // 2) :]}"


def shared_keys(word: str, places: list[int]) -> set[tuple[str, bool]]:
    """(key, longer): what a word shares with any other that differs by one edit.

    A key is the unedited side of a rare bigram. A side of up to WEAK code
    points is shared by many words; as one edit leaves a half of the other
    side alone as well, that half is added, for the length of the shorter
    word of a pair: longer marks the keys of a word as the longer one.
    """
    out = set()
    for i in places:
        for side, rest in ((f"<{word[: i + 2]}", word[i + 2 :]), (f">{word[i:]}", word[:i])):
            if len(side) > WEAK + 1:
                out.add((side, False))
                continue
            out |= {(f"{side}|{len(rest)}{half}", False) for half in halves(rest, len(rest))}
            if rest:
                out |= {(f"{side}|{len(rest) - 1}{half}", True) for half in halves(rest, len(rest) - 1)}
    return out


def keyed(words: DataFrame) -> DataFrame:
    """(key, longer, word, n) of shared_keys()."""
    shared = words.sparkSession.sparkContext.broadcast(gram_order(words))

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = shared.value
        for batch in batches:
            out: list[tuple[str, bool, str, int]] = []
            for word, n in zip(batch.column("word").to_pylist(), batch.column("n").to_pylist(), strict=True):
                out += [(key, longer, word, n) for key, longer in shared_keys(word, rare_places(word, order))]
            kinds = (pa.string(), pa.bool_(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out) if out else [()] * 4, kinds)], names=["key", "longer", "word", "n"])

    return words.select("word", "n").mapInArrow(keys, "key string, longer boolean, word string, n long")


def near_pairs(words: DataFrame, scratch: Scratch) -> DataFrame:
    """(word, n, other, other_n): every pair of words that differ by exactly one edit, both ways; pairs may repeat."""
    keys = scratch.keep(keyed(words), "keys")
    a = keys.where("not longer").select("key", F.col("word").alias("a"), F.col("n").alias("a_n"))
    b = keys.select("key", F.col("word").alias("b"), F.col("n").alias("b_n"), "longer")
    both = a.join(b, "key").where((F.col("longer") | (F.col("a") < F.col("b"))) & (F.levenshtein("a", "b", 1) == 1))
    ways = F.array(*[F.struct(F.col(x).alias("word"), F.col(f"{x}_n").alias("n"), F.col(y).alias("other"), F.col(f"{y}_n").alias("other_n")) for x, y in ("ab", "ba")])
    return both.select(F.inline(ways))


def variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """Per word of a dictionary (word, n): form (its near word of largest n, if that is ratio times its own or more), root (the last form of its chain, or itself), n, n_near and form_n."""
    spark = words.sparkSession
    scratch = Scratch(spark, "variants")
    words = scratch.keep(words.select("word", "n"), "words")
    # A word has few possible neighbours, so its rows meet in one task whatever the table's size.
    pairs = near_pairs(words, scratch).repartition("word").dropDuplicates(["word", "other"])
    near = pairs.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.max("n").alias("n"), F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best"))
    fits = -F.col("best.less") >= ratio * F.col("n")
    near = scratch.keep(near.select("word", "n_near", F.when(fits, F.col("best.other")).alias("form"), F.when(fits, -F.col("best.less")).alias("form_n")), "near")
    scratch.drop("keys")
    found = roots(near.where("form is not null").select("word", "form"), scratch)
    done = words.join(near, "word", "left").join(found, "word", "left")
    return scratch.keep(done.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_n"), "variants")


def roots(forms: DataFrame, scratch: Scratch) -> DataFrame:
    """(word, root): the end of each word's chain of forms, which has no circles; every step doubles how far roots reach."""
    reach = scratch.keep(forms.select("word", F.col("form").alias("root")), "reach0")
    step = 0
    while reach.join(forms.select(F.col("word").alias("root")), "root", "left_semi").limit(1).count():
        further = reach.select(F.col("word").alias("root"), F.col("root").alias("end"))
        step += 1
        reach = scratch.keep(reach.join(further, "root", "left").select("word", F.coalesce("end", "root").alias("root")), f"reach{step}")
    return reach
