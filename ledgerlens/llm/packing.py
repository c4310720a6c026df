"""Best-fit packing of token sequences by large-item matching.

Documents are tokenized and end with a token of their own; longer ones than a
sequence are cut into full pieces, the first of which may be shorter. Only the
number of pieces of each length matters to a packing, so the plan is made from
that histogram, of at most `capacity` rows, whatever the number of documents:

* pieces above a third of the capacity, of which two at most share a sequence,
  are matched from the largest down, each with the largest that still fits;
* smaller pieces, from the largest down, go to the sequences whose gap they
  fill best; those that fit nowhere open new ones.

The plan is a list of runs: so many pieces of a length, counted from a rank,
go to consecutive sequences. Pieces are ranked within their length by their
place in the partition that they are written in, and partitions by their
counts, so nothing is sorted and no task sees all pieces of a length.

A null text is empty and is a piece of one token, the end. Repeated rows are
documents of their own, null ids are kept. Texts of any length are tokenized
whole, in one task. Empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import base64
import re
import zlib
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ledgerlens.llm.common import Scratch, sized_broadcast
from ledgerlens.llm.kernels import slices

CAPACITY, END = 2048, 0
#: Bytes of texts that are tokenized at once.
TOGETHER = 16 << 20


class Encoder:
    """Token ids of texts by a byte-level BPE vocabulary: a tokenizer file, and the same ranks for its fast form.

    The vocabulary's pattern begins a new part at a space that follows a
    letter, digit or mark, so a part has the same ids wherever it stands, and
    the distinct parts of many texts are encoded once. Texts of ASCII and Latin
    letters go to the fast form, other parts to the tokenizer itself. Strings
    of special tokens are ordinary text.
    """

    #: Characters after which a space begins a new part, whatever a library's tables say of others.
    PLAIN = "\x21-\x7eÀ-ɏ"
    FINE = re.compile(f"[\n\t{PLAIN}]*+(?:(?<=[{PLAIN}]) [\n\t{PLAIN}]*+)*+")
    FAST = re.compile(f"[\n\t {PLAIN}]*+")
    PARTS = re.compile(f"(?<=[{PLAIN}])(?= )")

    def __init__(self, tokenizer: str, ranks: str, pattern: str):
        self.whole = Tokenizer.from_file(tokenizer)
        self.whole.encode_special_tokens = True
        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.begins = np.zeros(max(table.values()) + 1, bool)
        self.begins[[i for token, i in table.items() if token[:1] == b" "]] = True

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.fast.encode_ordinary(text), "<u4")

    def _mixed(self, text: str) -> bytes:
        """The ids of a text with parts that only the tokenizer itself is sure of."""
        runs = (("".join(run), plain) for plain, run in groupby(self.PARTS.split(text), key=lambda p: bool(self.FAST.fullmatch(p))))
        return b"".join([(self._ids(run) if plain else np.array(self.whole.encode(run, add_special_tokens=False).ids, "<u4")).tobytes() for run, plain in runs])

    def _fine(self, texts: list[str]) -> list[bytes]:
        parts = pc.split_pattern(pc.replace_substring(pa.array(texts, pa.large_string()), " ", "\x00 "), "\x00")
        coded = parts.flatten().dictionary_encode()
        distinct, place = coded.dictionary.to_pylist(), np.zeros(len(coded.dictionary), np.int64)
        spaced = np.array([p[:1] == " " for p in distinct], bool)
        # Parts behind a space are encoded together: only their first tokens begin with one.
        ids = self._ids("".join([p for p in distinct if p[:1] == " "]))
        firsts = [self._ids(p) for p in distinct if p[:1] != " "]
        lengths = [np.diff(np.append(np.flatnonzero(self.begins[ids]), len(ids))), np.array([len(x) for x in firsts], np.int64)]
        place[spaced], place[~spaced] = np.arange(spaced.sum()), np.arange(spaced.sum(), len(place))
        offsets = np.concatenate(([0], np.cumsum(np.concatenate(lengths)))).astype(np.int64)
        known = pa.LargeListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([ids, *firsts])))
        taken = known.take(pa.array(place[coded.indices.to_numpy()]))
        flat = np.asarray(taken.flatten()).tobytes()
        cuts = (4 * np.asarray(taken.offsets)[np.asarray(parts.offsets)]).tolist()
        return [flat[x:y] for x, y in zip(cuts, cuts[1:])]

    def __call__(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, little-endian numbers of 32 bits."""
        fine = [bool(self.FINE.fullmatch(t)) for t in texts]
        found = iter(self._fine([t for t, ok in zip(texts, fine) if ok]) if any(fine) else [])
        return [next(found) if ok else self._mixed(t) for t, ok in zip(texts, fine)]


_encoders: dict[tuple, Encoder] = {}


def public_encoder(name: str = "byte_bpe_50k") -> Encoder:
    """The encoder of a public vocabulary, loaded once a worker."""
    files = (public_tokenizers.path(f"{name}.json"), public_tokenizers.path(f"{name}.tiktoken"), public_tokenizers.PATTERN)
    if files not in _encoders:
        _encoders[files] = Encoder(*files)
    return _encoders[files]


def pieces(docs: DataFrame, encoder: Callable[[], Encoder] = public_encoder, capacity: int = CAPACITY, end: int = END, id_col: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """Pieces of tokenized documents: id, piece, start, length, ids_crc32, ids if asked for, and __part and __rank, a piece's place among those of its length in a partition."""
    kind = dict(docs.dtypes)[id_col]
    last = np.array([end], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, seen, part = encoder(), Counter(), TaskContext.get().partitionId()
        for batch in batches:
            for rows, texts in slices(batch, "text", TOGETHER):
                at, out, ids = [], [], []
                for i, data in enumerate(encode([t.decode() for t in texts])):
                    data += last
                    n = len(data) // 4
                    first = n % capacity or capacity
                    for k, start in enumerate([0, *range(first, n, capacity)]):
                        length = first if k == 0 else capacity
                        own = data[4 * start : 4 * (start + length)]
                        at.append(i)
                        out.append((k, start, length, zlib.crc32(own), part, seen[length]))
                        seen[length] += 1
                        if with_ids:
                            ids.append(own)
                columns = [pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), *[pa.int64()] * 5))]
                columns = [rows.column("__id").take(pa.array(at)), *columns]
                if with_ids:
                    flat = pa.Array.from_buffers(pa.int32(), sum(map(len, ids)) // 4, [None, pa.py_buffer(b"".join(ids))])
                    columns.append(pa.ListArray.from_arrays(pa.array(np.cumsum([0, *[len(x) // 4 for x in ids]]), pa.int32()), flat))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    names = [id_col, "piece", "start", "length", "ids_crc32", "__part", "__rank", *["ids"] * with_ids]
    schema = f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long, __part long, __rank long" + ", ids array<int>" * with_ids
    return docs.select(F.col(id_col).alias("__id"), "text").mapInArrow(cut, schema)


class _Gaps:
    """Ranges of open sequences by the tokens they still take."""

    def __init__(self):
        self.sizes: list[int] = []
        self.ranges: dict[int, list[tuple[int, int]]] = {}

    def add(self, gap: int, first: int, count: int) -> None:
        if gap and count:
            if gap not in self.ranges:
                insort(self.sizes, gap)
                self.ranges[gap] = []
            self.ranges[gap].append((first, count))

    def tightest(self, size: int) -> tuple[int, int, int] | None:
        """(gap, first, count) of a range with the least gap that takes the size; it is no longer here."""
        i = bisect_left(self.sizes, size)
        if i == len(self.sizes):
            return None
        gap = self.sizes[i]
        first, count = self.ranges[gap].pop()
        if not self.ranges[gap]:
            del self.ranges[gap]
            self.sizes.pop(i)
        return gap, first, count


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Runs (length, first rank, pieces, pieces a sequence, first sequence, offset) of a packing of so many pieces of each length."""
    left, gaps, runs = {n: c for n, c in counts.items() if c}, _Gaps(), []
    used, sequences = Counter(), 0

    def run(length: int, count: int, each: int, first: int, offset: int) -> None:
        runs.append((length, used[length], count, each, first, offset))
        used[length] += count

    large = sorted(n for n in left if 3 * n > capacity)
    while large:
        a = large[-1]
        i = bisect_left(large, capacity - a + 1) - 1  # the largest that fits beside a
        if i >= 0 and large[i] == a and left[a] == 1:  # but a itself is the last of its length
            i -= 1
        b = large[i] if i >= 0 else None
        count = left[a] if b is None else left[a] // 2 if b == a else min(left[a], left[b])
        run(a, 2 * count if b == a else count, 2 if b == a else 1, sequences, 0)
        left[a] -= 2 * count if b == a else count
        if b is not None and b != a:
            run(b, count, 1, sequences, a)
            left[b] -= count
        gaps.add(capacity - a - (b or 0), sequences, count)
        sequences += count
        large = [n for n in large if left[n]]
    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        rest = left[n]
        while rest:
            found = gaps.tightest(n)
            if found is None:
                found = capacity, sequences, -(-rest // (capacity // n))
                sequences += found[2]
            gap, first, count = found
            each = gap // n
            full = min(count, rest // each)
            if full:
                run(n, full * each, each, first, capacity - gap)
                gaps.add(gap - each * n, first, full)
            rest -= full * each
            some = min(rest, each) if full < count else 0
            if some:  # the last sequence takes what is left of this length
                run(n, some, some, first + full, capacity - gap)
                gaps.add(gap - some * n, first + full, 1)
                rest -= some
            gaps.add(gap, first + full + bool(some), count - full - bool(some))
    return runs


def pack(docs: DataFrame, encoder: Callable[[], Encoder] = public_encoder, capacity: int = CAPACITY, end: int = END, id_col: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """pieces() with sequence_id and offset, their place in packed sequences."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    cut = scratch.keep(pieces(docs, encoder, capacity, end, id_col, with_ids), "pieces")
    counts = scratch.keep(cut.groupBy(F.col("length").alias("__length"), F.col("__part").alias("__of")).agg(F.count(F.lit(1)).alias("__n")), "counts")
    before = W.partitionBy("__length").orderBy("__of").rowsBetween(W.unboundedPreceding, -1)
    counts = scratch.keep(counts.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))), "before")
    histogram = {r[0]: r[1] for r in counts.groupBy("__length").agg(F.sum("__n")).collect()}  # at most capacity rows
    runs = np.array(plan(histogram, capacity), np.int64).reshape(-1, 6)
    shared = spark.sparkContext.broadcast(runs[np.lexsort((runs[:, 1], runs[:, 0]))])
    ranked = cut.join(sized_broadcast(counts.drop("__n"), counts.count()), (F.col("length") == F.col("__length")) & (F.col("__part") == F.col("__of")))
    ranked = ranked.withColumn("__rank", F.col("__rank") + F.col("__before")).drop("__length", "__of", "__part", "__before")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        start = np.searchsorted(own[:, 0], np.arange(capacity + 2))
        for batch in batches:
            length, rank = np.asarray(batch.column("length")), np.asarray(batch.column("__rank"))
            at = np.zeros(len(length), np.int64)
            for n in np.unique(length):  # the run of a rank among those of its length
                mine = length == n
                at[mine] = start[n] + np.searchsorted(own[start[n] : start[n + 1], 1], rank[mine], "right") - 1
            k = rank - own[at, 1]
            columns = {c: batch.column(c) for c in batch.schema.names if c != "__rank"}
            columns |= {"sequence_id": pa.array(own[at, 4] + k // own[at, 3]), "offset": pa.array(own[at, 5] + k % own[at, 3] * length)}
            yield pa.RecordBatch.from_pydict(columns)

    kinds = [(c, t) for c, t in ranked.dtypes if c != "__rank"] + [("sequence_id", "bigint"), ("offset", "bigint")]
    return ranked.mapInArrow(place, ", ".join(f"`{c}` {t}" for c, t in kinds))


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids) of the pieces of pack(..., with_ids=True): a sequence has at most as many pieces as tokens."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(parts["ids"]).alias("ids"))
