"""Benchmark decontamination by a stored, distributed positional inverted index.

The index is a written table. Documents are dealt to shards, bounded slices of
the texts as they lie, and each shard has a row for every term in it with the
sorted list of its positions, and a directory of its documents. So a term of
any frequency is in pieces, and neither building nor storing shuffles. A search
reads the lists of the test terms only and brings those of a shard together.

Test phrases are searched in blocks of at most BLOCK_TERMS terms, one block
after another. The stored counts of a block's terms give their rarity over all
documents; phrases with a term that occurs nowhere are done. In each shard, the
positions of a phrase's rarest term, less its offset, are candidate starts, and
the list of each further term, in order of rarity and less its own offset, is
intersected with them. proximity() intersects lists within a distance instead.

Null text has no words; items without words occur nowhere. Items with a null id
are searched like others and their words are hit, but they have no name to be
listed or counted under. Equal items are all reported, items that share an id
once. Repeated rows give repeated results, null ids are ids like others; empty
tables give empty results. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import Scratch, whole
from ledgerlens.llm.kernels import ALNUM, joined_hashes, slices, word_hashes

WINDOW = 10
#: Terms of test phrases that are searched, and broadcast, at once.
BLOCK_TERMS = 1_000_000
#: Candidate starts held at once.
CANDIDATES = 1 << 20


# -- the index ---------------------------------------------------------------------------------
def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, h, text) to rows of shards: the directory (no term), then a row per term with the steps between its positions."""
    context = TaskContext.get()
    shard = (context.partitionId() if context else 0) << 32
    for batch in batches:
        for part, texts in slices(batch, "text"):
            tokens, starts, counts = joined_hashes(texts, ALNUM)
            places = np.argsort(tokens, kind="stable")
            terms, first = np.unique(tokens[places], return_index=True)
            steps = np.diff(places, prepend=0).astype(np.int32)
            steps[first] = places[first]
            lists = np.append(first, len(places)).astype(np.int64)
            postings = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(terms), [None, pa.py_buffer(lists * 4), pa.py_buffer(steps)])
            documents = pa.StructArray.from_arrays([part.column("id"), part.column("h"), pa.array(starts.astype(np.int32)), pa.array(counts.astype(np.int32))], names=["id", "h", "start", "words"])
            directory = pa.ListArray.from_arrays(pa.array([0, len(texts)], pa.int32()), documents)
            names = ["shard", "term", "n", "postings", "documents"]
            none = pa.nulls(1, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([shard]), none, pa.array([len(tokens)], pa.int32()), pa.array([starts.astype(np.int32).tobytes()], pa.binary()), directory], names=names)
            if len(terms):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(terms), shard)), pa.array(terms.view(np.int64)), pa.array(np.diff(lists).astype(np.int32)), postings.cast(pa.binary()), pa.nulls(len(terms), directory.type)], names=names)
            shard += 1


def build_index(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The index of docs: shard, term, n, postings, documents. h, a hash of the text, tells rows of one id apart."""
    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"))
    return scratch.keep(rows.mapInArrow(_index, f"shard long, term long, n int, postings binary, documents array<struct<id:{kind},h:long,start:int,words:int>>"), "index")


def indexed_documents(index: DataFrame) -> DataFrame:
    """shard, k (the document's number in it), id, h and words of every indexed row."""
    return index.where("term is null").select("shard", F.posexplode("documents").alias("k", "d")).select("shard", "k", "d.id", "d.h", "d.words")


class Shard:
    """What a search reads of a shard: starts of its documents, and the positions of some terms, list after list in order of terms."""

    def __init__(self, number: int, rows: pa.Table):
        lists = rows.column("postings").to_pylist()
        self.number, self.size = number, rows.column("n")[0].as_py()
        self.starts = np.frombuffer(lists[0], np.int32).astype(np.int64)
        self.terms = np.asarray(rows.column("term").slice(1)).astype(np.int64)
        self.lengths = np.asarray(rows.column("n").slice(1)).astype(np.int64)
        self.first = np.concatenate(([0], np.cumsum(self.lengths)))
        sums = np.concatenate(([0], np.cumsum(np.frombuffer(b"".join(lists[1:]), np.int32).astype(np.int64))))
        number_of = np.repeat(np.arange(len(self.terms)), self.lengths)
        self.positions = sums[1:] - sums[self.first[:-1]][number_of]
        self.keys = number_of << 32 | self.positions

    def lists(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of each term's list, and whether there is one."""
        if not len(self.terms):
            return np.zeros(terms.shape, np.int64), np.zeros(terms.shape, bool)
        i = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        return i, self.terms[i] == terms

    def text_of(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, positions, "right") - 1

    def phrases(self, terms: np.ndarray, rarity: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Start positions and row numbers of exact occurrences of rows of terms, each with its offsets from the rarest term on."""
        lists, known = self.lists(terms)
        rows = np.flatnonzero(known.all(axis=1))
        rare = rarity[rows, 0]
        own = lists[rows, rare]
        load = self.lengths[own]
        group = np.cumsum(load) // CANDIDATES
        for g in np.unique(group):
            of = np.flatnonzero(group == g)
            row = np.repeat(of, load[of])
            at = np.arange(len(row)) - np.repeat(np.cumsum(load[of]) - load[of], load[of])
            start = self.positions[self.first[own[row]] + at] - rare[row]
            row, start = row[start >= 0], start[start >= 0]
            for j in range(1, terms.shape[1]):  # intersect with the next list, less its offset
                offset = rarity[rows[row], j]
                wanted = lists[rows[row], offset] << 32 | (start + offset)
                i = np.searchsorted(self.keys, wanted)
                fine = self.keys[np.minimum(i, len(self.keys) - 1)] == wanted
                row, start = row[fine], start[fine]
            within = self.text_of(start) == self.text_of(start + terms.shape[1] - 1)
            if within.any():
                yield start[within], rows[row[within]]

    def near(self, terms: np.ndarray, slop: int) -> np.ndarray:
        """Positions of the first of terms within slop words of which every other one stands, in the same text."""
        lists, known = self.lists(terms)
        if not known.all():
            return np.zeros(0, np.int64)
        parts = [self.positions[self.first[i] : self.first[i + 1]] for i in lists]
        at = parts[0]
        low = np.maximum(at - slop, self.starts[self.text_of(at)])
        for other in parts[1:]:
            i = np.searchsorted(other, low)
            following = other[np.minimum(i, len(other) - 1)]
            fine = (i < len(other)) & (following <= at + slop) & (self.text_of(following) == self.text_of(at))
            at, low = at[fine], low[fine]
        return at


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[Shard]:
    """The shards of rows (shard, term, n, postings), sorted."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        own = np.asarray(batch.column("shard"))
        cuts = [0, *(np.flatnonzero(own[1:] != own[:-1]) + 1).tolist(), len(own)]
        for a, b in zip(cuts, cuts[1:]):
            if held and a < b and held[0].column("shard")[0].as_py() != own[a]:
                yield Shard(held[0].column("shard")[0].as_py(), pa.Table.from_batches(held))
                held = []
            if a < b:
                held.append(batch.slice(a, b - a))
    if held:
        yield Shard(held[0].column("shard")[0].as_py(), pa.Table.from_batches(held))


def _lists(index: DataFrame, terms: np.ndarray) -> DataFrame:
    """The directory and the lists of some terms, at most BLOCK_TERMS, of every shard, shard by shard."""
    wanted = F.broadcast(index.sparkSession.createDataFrame(pa.table({"term": pa.array(terms, pa.int64()), "wanted": pa.array([True] * len(terms), pa.bool_())})))
    rows = index.select("shard", "term", "n", "postings").join(wanted, "term", "left").where("wanted or term is null")
    return rows.select("shard", "term", "n", "postings").repartition("shard").sortWithinPartitions("shard", "term")


def _counts(index: DataFrame, terms: DataFrame) -> dict[int, int]:
    """How often each of a block's terms occurs, by the stored counts."""
    found = index.where("term is not null").select("term", "n").join(F.broadcast(terms), "term").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    return dict(zip(found["term"].to_pylist(), found["n"].to_pylist()))


# -- phrases -----------------------------------------------------------------------------------
def _windows(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for item, text in zip(batch.column("item").to_pylist(), batch.column("text")):
            words = word_hashes((text.as_py() or "").encode(), ALNUM).view(np.int64)
            n = min(window, len(words))
            for at in range(0, len(words) - n + 1 if n else 0, 10_000):
                own = np.lib.stride_tricks.sliding_window_view(words, n)[at : at + 10_000]
                yield pa.RecordBatch.from_arrays([pa.array([item] * len(own), pa.string()), pa.array([xxhash.xxh3_128_digest(x.tobytes()) for x in own], pa.binary()), pa.array(list(own), pa.list_(pa.int64()))], names=["item", "w", "terms"])


def _search(batches: Iterator[pa.RecordBatch], phrases: list[tuple]) -> Iterator[pa.RecordBatch]:
    """Per shard and document k: runs [a, b) of hit words, and rows of the phrases w that occur in it."""
    for shard in _shards(batches):
        edges = np.zeros(shard.size + 1, np.int64)
        k, w = [np.zeros(0, np.int64)], [pa.array([], pa.binary())]
        for terms, rarity, names in phrases:
            for start, row in shard.phrases(terms, rarity):
                np.add.at(edges, start, 1)
                np.add.at(edges, start + terms.shape[1], -1)
                both = np.unique(shard.text_of(start) * len(terms) + row)
                k.append(both // len(terms))
                w.append(names.take(pa.array(both % len(terms))))
        k, w = np.concatenate(k), pa.concat_arrays(w)
        if not len(k):
            continue
        hit = np.concatenate(([False], np.cumsum(edges[:-1]) > 0, [False]))
        begins, one = np.zeros(shard.size + 1, bool), shard.starts
        begins[one] = True  # runs end with their text
        a = np.flatnonzero(hit[1:-1] & (~hit[:-2] | begins[:-1]))
        b = np.flatnonzero(hit[1:-1] & (~hit[2:] | begins[1:])) + 1
        text = shard.text_of(a)
        n, m = len(a), len(k)
        columns = [pa.array(np.full(n + m, shard.number)), pa.array(np.concatenate((text, k)).astype(np.int32)), *[pa.concat_arrays([pa.array((x - one[text]).astype(np.int32)), pa.nulls(m, pa.int32())]) for x in (a, b)], pa.concat_arrays([pa.nulls(n, pa.binary()), w])]
        yield pa.RecordBatch.from_arrays(columns, names=["shard", "k", "a", "b", "w"])


def find_phrases(index: DataFrame, windows: DataFrame, scratch: Scratch, window: int = WINDOW) -> DataFrame:
    """Rows (shard, k, a, b) of hit words and (shard, k, w) of the windows (w, terms) that occur, block after block of windows."""
    spark, found = index.sparkSession, None
    blocks = max(1, -(-windows.count() * window // BLOCK_TERMS))
    for b in range(blocks):
        own = windows.where(F.pmod(F.xxhash64("w"), F.lit(blocks)) == b) if blocks > 1 else windows
        counts = _counts(index, own.select(F.explode("terms").alias("term")).distinct())
        table = own.select("w", "terms").toArrow()
        by: dict[int, list[tuple]] = {}
        for w, terms in zip(table["w"].to_pylist(), table["terms"].to_pylist()):
            if all(t in counts for t in terms):
                by.setdefault(len(terms), []).append((w, terms, [counts[t] for t in terms]))
        phrases = [(np.array([t for _, t, _ in x], np.int64), np.argsort(np.array([c for _, _, c in x]), axis=1, kind="stable"), pa.array([w for w, _, _ in x], pa.binary())) for x in by.values()]
        needed = np.unique(np.concatenate([t.ravel() for t, _, _ in phrases])) if phrases else np.zeros(0, np.int64)
        shared = spark.sparkContext.broadcast(phrases)
        part = scratch.keep(_lists(index, needed).mapInArrow(lambda it, s=shared: _search(it, s.value), "shard long, k int, a int, b int, w binary"), f"found{b}")
        shared.destroy()
        found = part if found is None else found.unionByName(part)
    return found


def _covered(runs) -> F.Column:
    """How many numbers a list of runs [a, b) covers."""

    def add(acc, r):
        new = F.greatest(F.lit(0), r["b"] - F.greatest(r["a"], acc["end"]))
        return F.struct(F.greatest(acc["end"], r["b"]).alias("end"), (acc["n"] + new).alias("n"))

    return F.aggregate(F.array_sort(runs), F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")), add, lambda a: a["n"])


def _hits(docs: DataFrame, benchmark: DataFrame, scratch: Scratch, id_col: str, item_col: str, window: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The index of docs, what find_phrases() finds in it, and the items (w, item) of each window."""
    index = build_index(docs, scratch, id_col)
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col("text"))
    rows = scratch.keep(items.mapInArrow(lambda it: _windows(it, window), "item string, w binary, terms array<long>"), "windows")
    windows = scratch.keep(rows.groupBy("w").agg(F.first("terms").alias("terms")), "distinct")
    return index, find_phrases(index, windows, scratch, window), rows.where("item is not null").select("w", "item").distinct()


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", item_col: str = "item_id", window: int = WINDOW) -> DataFrame:
    """Per row: its id, words, words hit by a window of an item, items with windows that occur, and their list."""
    scratch = Scratch(docs.sparkSession, "decontamination")
    index, found, owners = _hits(docs, benchmark, scratch, id_col, item_col, window)
    hit = found.where("w is null").groupBy("shard", "k").agg(_covered(F.collect_list(F.struct("a", "b"))).alias("n_hit"))
    pairs = found.where("w is not null").select("shard", "k", "w").join(owners, "w").select("shard", "k", "item").distinct()
    items = pairs.groupBy("shard", "k").agg(F.array_sort(F.collect_list("item")).alias("items"))
    rows = indexed_documents(index).join(hit.hint("merge"), ["shard", "k"], "left").join(items.hint("merge"), ["shard", "k"], "left")
    n_hit, names = F.coalesce("n_hit", F.lit(0).cast("long")), F.coalesce("items", F.array().cast("array<string>"))
    return rows.select(F.col("id").alias(id_col), F.col("words").cast("long").alias("n_words"), n_hit.alias("n_hit"), F.size(names).cast("long").alias("n_items"), F.sha2(F.array_join(names, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"), names.alias("items"))


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", item_col: str = "item_id", window: int = WINDOW) -> DataFrame:
    """The rows of docs, with all their columns, in which no window of an item occurs."""
    scratch = Scratch(docs.sparkSession, "decontamination")
    index, found, _ = _hits(docs, benchmark, scratch, id_col, item_col, window)
    own = indexed_documents(index).join(found.select("shard", "k").distinct().hint("merge"), ["shard", "k"], "left_semi")
    lost = own.select(F.col("id").alias("__lost"), F.col("h").alias("__h")).distinct().hint("merge")  # the same plan at every size
    return docs.join(lost, F.col(f"`{id_col}`").eqNullSafe(F.col("__lost")) & (F.xxhash64("text") == F.col("__h")), "left_anti")


# -- proximity ---------------------------------------------------------------------------------
def proximity(docs: DataFrame, queries: DataFrame, slop: int, rarest: int | None = None, id_col: str = "doc_id") -> DataFrame:
    """Per row and query (name, text) with matches: places of its rarest word with all others (or the rarest so many) within slop words.

    Words of a query that occur nowhere leave it without matches, unless the
    rarest few are asked for: these are chosen among those that occur, ties by
    their place in the query.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "proximity")
    index = build_index(docs, scratch, id_col)
    rows = queries.select(F.col("name").cast("string").alias("item"), whole(F.col("text")).alias("text")).mapInArrow(_query_terms, "item string, terms array<long>")
    rows = scratch.keep(rows, "queries")
    blocks = max(1, -(-(rows.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()[0]) // BLOCK_TERMS))
    out = None
    for b in range(blocks):
        own = rows.where(F.pmod(F.xxhash64("item", "terms"), F.lit(blocks)) == b) if blocks > 1 else rows
        counts = _counts(index, own.select(F.explode("terms").alias("term")).distinct())
        asked = []
        for r in own.toLocalIterator():
            known = [t for t in r.terms if t in counts]
            if len(known) == len(r.terms) or rarest:
                asked.append((r.item, np.array(sorted(known, key=counts.get)[:rarest], np.int64)))
        asked = [(name, t) for name, t in asked if len(t)]
        needed = np.unique(np.concatenate([t for _, t in asked])) if asked else np.zeros(0, np.int64)
        shared = spark.sparkContext.broadcast(asked)
        part = scratch.keep(_lists(index, needed).mapInArrow(lambda it, s=shared: _near(it, s.value, slop), "shard long, k int, query string, matches long"), f"near{b}")
        shared.destroy()
        out = part if out is None else out.unionByName(part)
    return indexed_documents(index).join(out, ["shard", "k"]).select(F.col("id").alias(id_col), "query", "matches")


def _query_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        terms = [list(dict.fromkeys(word_hashes(t.encode(), ALNUM).view(np.int64).tolist())) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("item"), pa.array(terms, pa.list_(pa.int64()))], names=["item", "terms"])


def _near(batches: Iterator[pa.RecordBatch], asked: list[tuple[str, np.ndarray]], slop: int) -> Iterator[pa.RecordBatch]:
    for shard in _shards(batches):
        for name, terms in asked:
            k, n = np.unique(shard.text_of(shard.near(terms, slop)), return_counts=True)
            if len(k):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), shard.number)), pa.array(k.astype(np.int32)), pa.array([name] * len(k), pa.string()), pa.array(n, pa.int64())], names=["shard", "k", "query", "matches"])
