"""Removal of repeated byte strings by longest previous factors in suffix order.

A byte goes if a string of LENGTH bytes that covers it also starts earlier: in
a document of smaller id, or earlier in the same one. So each start of such a
window asks whether its longest previous factor reaches LENGTH.

Suffixes are partitioned by content: of every window, the GRAM bytes of least
hash are its anchor, so equal windows have equal anchors at equal offsets, and
windows of unlike anchors need not meet. Neighbouring windows with the same
anchor form a piece. Pieces whose anchor occurs once are done after a count. Of
equal pieces, told by hashes of anchor and text, only the first goes on: the
others repeat it wholly. The windows of what is left are sorted in blocks of
whole anchors, which gives a suffix array with common prefixes; the previous
and the next smaller position in that order give each window's longest previous
factor, and windows of LENGTH go.

Anchors of more than SPLIT different pieces are split on longer strings: their
windows are parted by the distance to the anchor, so that those of a part share
LENGTH - 10 bytes (and LENGTH, if that is still too many), and go the same way
again. With LENGTH bytes all windows of a part are equal, so no part stays
larger.

Null texts are empty. Ids may be of any ordered type; a null id comes before
all others. Rows that repeat an id (or null) with the same text are one
document and give equal results; those with different texts are different
documents, ordered by a hash of the text. An empty table gives an empty one,
and other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import Scratch, sized_broadcast, whole
from ledgerlens.llm.kernels import SLICE_BYTES, U, mix, slices

LENGTH, GRAM = 100, 24
#: Windows of an anchor that are kept together, by their distance to it: all, then these many distances.
WIDTHS = (LENGTH - GRAM + 1, 11, 1)
#: Different pieces of one anchor that a task may sort, and windows sorted at once.
SPLIT, BLOCK = 1000, 250_000
PIECES = "g long, x long, p int, n short, off short"


def gram_hashes(data: bytes) -> np.ndarray:
    """A hash of the GRAM bytes from each position on."""
    n = len(data) - GRAM + 1
    if n <= 0:
        return np.zeros(0, U)
    v = np.empty(len(data) - 7, U)
    for o in range(8):
        part = np.frombuffer(data, "<u8", (len(data) - o) // 8, o)
        v[o::8] = part
    h = v[:n] * U(0x9E3779B97F4A7C15)
    h ^= h >> U(29)
    for i, p in ((8, 0xD6E8FEB86659FD93), (16, 0xA0761D6478BD642F)):
        h += v[i : i + n]
        h *= U(p)
        h ^= h >> U(32)
    return mix(h)


def pieces(texts: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The texts joined, and of every piece: its text's number, its first window's place, its windows, its anchor's place and hash."""
    data = b"".join(texts)
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes)
    none = np.zeros(0, np.int64)
    if len(data) < LENGTH:
        return data, none, none, none, none, np.zeros(0, U)
    h = gram_hashes(data)
    b = U(int(len(data)).bit_length())
    low = (h >> b << b) | np.arange(len(h), dtype=U)  # ties go to the left
    width, span = LENGTH - GRAM + 1, 1
    while span * 2 <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if width > span:
        low = np.minimum(low[: len(low) - (width - span)], low[width - span :])
    anchor = (low & ((U(1) << b) - U(1))).astype(np.int64)  # of the window at each place
    valid = np.ones(len(anchor), bool)
    for e in ends[:-1]:
        valid[max(0, e - LENGTH + 1) : e] = False
    place = np.flatnonzero(valid)
    if not len(place):
        return data, none, none, none, none, np.zeros(0, U)
    own = anchor[place]
    cut = np.flatnonzero(np.concatenate(([True], (own[1:] != own[:-1]) | (place[1:] != place[:-1] + 1))))
    count = np.diff(np.append(cut, len(place)))
    first, at = place[cut], own[cut]
    return data, np.searchsorted(ends, first, "right"), first, count, at, h[at]


def _hashes(data: bytes, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(data[a:b]) for a, b in zip(begin.tolist(), end.tolist())], U)


def _rows(part: pa.RecordBatch, row: np.ndarray, columns: dict[str, np.ndarray], more: dict[str, pa.Array]) -> pa.RecordBatch:
    """Rows of columns with the id and tie of their row of part."""
    own, kinds = pa.array(row, pa.int64()), {"p": np.int32, "n": np.int16, "off": np.int16}
    arrays = {"id": part.column("id").take(own), "tie": part.column("tie").take(own)} | {c: pa.array(x.view(np.int64) if c in "gx" else x.astype(kinds[c])) for c, x in columns.items()} | more
    return pa.RecordBatch.from_arrays(list(arrays.values()), names=list(arrays))


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts to pieces; a text longer than a slice is read segment by segment."""
    for batch in batches:
        for part, texts in slices(batch, "text"):
            starts = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
            for at in range(0, max(1, len(texts[0])), SLICE_BYTES) if len(texts) == 1 else (0,):
                own = [texts[0][at : at + SLICE_BYTES + LENGTH - 1]] if len(texts) == 1 else texts
                data, text, first, n, anchor, g = pieces(own)
                x = _hashes(data, first, first + n + (LENGTH - 1))
                yield _rows(part, text, {"g": g, "x": x, "p": first - starts[text] + at, "n": n, "off": anchor - first}, {})


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, tie, text, own: pieces of the text) to pieces with their bytes."""
    for batch in batches:
        for part, texts in slices(batch, "text"):
            own = part.column("own")
            flat, text = own.flatten(), np.repeat(np.arange(part.num_rows), np.diff(np.asarray(own.offsets)))
            p, n = np.asarray(flat.field("p")), np.asarray(flat.field("n"))
            out = [texts[t][a:b] for t, a, b in zip(text.tolist(), p.tolist(), (p + n + (LENGTH - 1)).tolist())]
            yield _rows(part, text, {}, {c: flat.field(c) for c in ("p", "n", "off", "g", "m")} | {"bytes": pa.array(out, pa.binary())})


def _split(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Pieces to pieces of windows of width neighbouring distances to their anchor, under what all of these contain."""
    for batch in batches:
        for at in range(0, batch.num_rows, 5000):
            part = batch.slice(at, 5000)
            texts = part.column("bytes").to_pylist()
            data, starts = b"".join(texts), np.concatenate(([0], np.cumsum([len(t) for t in texts])))
            p, n, off = (np.asarray(part.column(c)).astype(np.int64) for c in ("p", "n", "off"))
            low, high = (off - n + 1) // width, off // width  # of the last and the first window
            row = np.repeat(np.arange(len(n)), high - low + 1)
            j = (low[row] + np.arange(len(row)) - np.searchsorted(row, row)) * width
            first, last = np.maximum(0, off[row] - j - width + 1), np.minimum(n[row] - 1, off[row] - j)
            shared, begin, end = starts[row] + off[row] - j, starts[row] + first, starts[row] + last + LENGTH
            g, x = mix(_hashes(data, shared, shared + LENGTH + 1 - width) + j.astype(U)), _hashes(data, begin, end)
            out = pa.array([data[a:b] for a, b in zip(begin.tolist(), end.tolist())], pa.binary())
            yield _rows(part, row, {"g": g, "x": x, "p": p[row] + first, "n": last - first + 1, "off": off[row] - first}, {"bytes": out})


def longest_previous_factors(position: np.ndarray, common: np.ndarray, wanted: int = 1) -> np.ndarray:
    """For suffixes in order, the longest common prefix with one of smaller position; right where it is wanted or more, else less than that.

    position: of each suffix; common[i]: its common prefix with the one before
    it. The nearest smaller positions before and after it in the order are the
    candidates, and the longer common prefix is the answer. They are found by
    jumps: a suffix whose candidate is larger takes over that one's candidate.
    """
    out = np.zeros(len(position), np.int64)
    for turned in (False, True):
        p = position[::-1] if turned else position
        c = np.concatenate(([0], common[:0:-1])) if turned else np.concatenate(([0], common[1:]))
        at, least = np.arange(len(p)) - 1, c.astype(np.int64)
        live = np.flatnonzero(least >= wanted)
        while len(live := live[p[at[live]] > p[live]]):
            step = at[live]
            least[live], at[live] = np.minimum(least[live], least[step]), at[step]
            live = live[(least[live] >= wanted) & (at[live] >= 0)]
        out = np.maximum(out, (least if not turned else least[::-1]))
    return out


def suffix_order(group: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of rows of bytes within groups, and each row's common prefix with the one before it; none across groups."""
    rows = np.concatenate((group.astype(">u4").view(np.uint8).reshape(-1, 4), texts), axis=1)
    order = np.argsort(rows.view(f"S{rows.shape[1]}").ravel(), kind="stable")
    sorted_ = rows[order]
    unlike = sorted_[1:] != sorted_[:-1]
    common = np.where(unlike.any(axis=1), unlike.argmax(axis=1) - 4, texts.shape[1])
    return order, np.concatenate(([0], np.maximum(common, 0)))


def repeats(g: np.ndarray, p: np.ndarray, n: np.ndarray, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs (piece, first window, windows) of windows that start earlier in another of these pieces, which are in order of anchor and position."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    starts = np.concatenate(([0], np.cumsum([len(t) for t in texts])))[:-1]
    row = np.repeat(np.arange(len(n)), n)
    i = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    windows = np.lib.stride_tricks.sliding_window_view(data, LENGTH)[starts[row] + i]
    order, common = suffix_order((np.cumsum(np.concatenate(([0], g[1:] != g[:-1]))))[row], windows)
    again = np.zeros((len(n), LENGTH - GRAM + 3), np.int8)
    again[row[order], i[order] + 1] = longest_previous_factors(order, common, LENGTH) >= LENGTH
    step = np.diff(again, axis=1)
    piece, begin = np.nonzero(step == 1)
    _, end = np.nonzero(step == -1)
    return piece, p[piece] + begin, end - begin


def _block_repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces sorted by anchor and position to runs of repeated windows, block after block of whole anchors."""
    held: list[pa.RecordBatch] = []
    size = 0

    def run(rows: pa.RecordBatch) -> pa.RecordBatch:
        piece, p, n = repeats(*[np.asarray(rows.column(c)).astype(np.int64) for c in ("g", "p", "n")], rows.column("bytes").to_pylist())
        own = pa.array(piece)
        return pa.RecordBatch.from_arrays([rows.column("id").take(own), rows.column("tie").take(own), pa.array(p.astype(np.int32)), pa.array(n.astype(np.int32))], names=["id", "tie", "p", "n"])

    for batch in batches:
        for at in range(0, batch.num_rows, 1000):  # a batch may hold many blocks
            held.append(batch.slice(at, 1000))
            size += int(np.asarray(held[-1].column("n")).sum())
            if size < BLOCK:
                continue
            rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            g = np.asarray(rows.column("g"))
            cut = int(np.searchsorted(g, g[-1]))  # the last anchor may go on
            if cut:
                yield run(rows.slice(0, cut))
            held = [rows.slice(cut)]
            size = int(np.asarray(held[0].column("n")).sum())
    if size:
        yield run(pa.Table.from_batches(held).combine_chunks().to_batches()[0])


def covered(size: int, p: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes that windows p, ..., p + n - 1 cover."""
    if not len(p):
        return p, p
    order = np.argsort(p, kind="stable")
    s, e = p[order], np.maximum.accumulate((p + n + (LENGTH - 1))[order])
    new = np.flatnonzero(np.concatenate(([True], s[1:] > e[:-1])))
    return s[new], e[np.append(new[1:] - 1, len(s) - 1)]


def _remove(batches: Iterator[pa.RecordBatch], with_text: bool) -> Iterator[pa.RecordBatch]:
    names = ["n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept_bytes"] * with_text
    for batch in batches:
        for part, texts in slices(batch, "text"):
            own, out = part.column("own").to_pylist(), []
            for t, runs in zip(texts, own):
                runs = runs or []
                s, e = covered(len(t), np.array([r["p"] for r in runs], np.int64), np.array([r["n"] for r in runs], np.int64))
                kept = b"".join(t[a:b] for a, b in zip([0, *e.tolist()], [*s.tolist(), len(t)]))
                out.append((len(t), len(t) - len(kept), len(s), hashlib.sha256(kept).hexdigest(), kept)[: len(names)])
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *[pa.array(c, k) for c, k in zip(zip(*out), kinds)]], names=["doc_id", *names])


def repeated_windows(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """Runs (id, tie, p, n) of windows of docs (id, tie, text) that start earlier: the n windows from byte p on."""
    kind = dict(docs.dtypes)["id"]
    key, runs, out = f"id {kind}, tie long", f"id {kind}, tie long, p int, n int", []
    place = ["id", "tie", "p", "n", "off"]
    found = docs.mapInArrow(_anchors, f"{key}, {PIECES}")
    for k, width in enumerate(WIDTHS):
        found = scratch.keep(found, f"anchors{k}")
        if k:
            scratch.drop(f"texts{k - 1}")
        # Written first, and merged: a join of two plain exchanges is one whose hot keys Spark can split, and the same at every size.
        more = scratch.keep(found.groupBy("g").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("g"), f"more{k}")
        found = scratch.keep(found.join(more.hint("merge"), "g"), f"repeated{k}")
        scratch.drop(f"anchors{k}", f"more{k}")
        first = scratch.keep(found.groupBy("g", "x").agg(F.min(F.struct(*place, *["bytes"] * (k > 0))).alias("f"), F.count(F.lit(1)).alias("c")), f"pieces{k}")
        own = first.where("c > 1").select("g", "x", F.col("f.id").alias("i"), F.col("f.tie").alias("t"), F.col("f.p").alias("q"))
        again = found.join(own.hint("merge"), ["g", "x"]).where(~(F.col("id").eqNullSafe(F.col("i")) & (F.col("tie") == F.col("t")) & (F.col("p") == F.col("q"))))
        out.append(scratch.keep(again.select("id", "tie", "p", F.col("n").cast("int").alias("n")), f"again{k}"))
        scratch.drop(f"repeated{k}")
        unlike = scratch.keep(first.groupBy("g").agg(F.count(F.lit(1)).alias("m")).where("m > 1"), f"unlike{k}")
        rest = first.select("g", "f").join(unlike.hint("merge"), "g")
        texts = _with_bytes(docs, rest, f"{key}, p int, n short, off short, g long, m long, bytes binary") if k == 0 else rest.select("f.*", "g", "m")
        texts = scratch.keep(texts, f"texts{k}")
        scratch.drop(f"pieces{k}", f"unlike{k}")
        last = width == 1  # the windows of a part are equal, so none is left but by equal hashes
        ordered = (texts if last else texts.where(F.col("m") <= SPLIT)).repartition("g").sortWithinPartitions("g", "id", "tie", F.col("p") + F.col("off"))
        out.append(scratch.keep(ordered.mapInArrow(_block_repeats, runs), f"sorted{k}"))
        hot = texts.where(F.col("m") > SPLIT)
        if last or hot.isEmpty():
            scratch.drop(f"texts{k}")
            break
        found = hot.mapInArrow(lambda it, w=WIDTHS[k + 1]: _split(it, w), f"{key}, {PIECES}, bytes binary")
    both = out[0]
    for other in out[1:]:
        both = both.unionByName(other)
    return both


def _with_bytes(docs: DataFrame, rest: DataFrame, schema: str) -> DataFrame:
    """The pieces of rest (g, f, m) with their bytes, cut from the texts of docs."""
    own = rest.groupBy("f.id", "f.tie").agg(F.collect_list(F.struct("f.p", "f.n", "f.off", "g", "m")).alias("own")).withColumnsRenamed({"id": "__i", "tie": "__t"})
    both = docs.join(own.hint("merge"), F.col("id").eqNullSafe(F.col("__i")) & (F.col("tie") == F.col("__t")))
    return both.select("id", "tie", "text", "own").mapInArrow(_cut, schema)


def without_repeats(docs: DataFrame, with_text: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and kept_bytes if asked for."""
    scratch = Scratch(docs.sparkSession, "repeats")
    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("id"), F.lit(0).cast("long").alias("tie"), whole(F.col(text_col)).alias("text"))
    many = scratch.keep(rows.groupBy("id").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select(F.col("id").alias("j"), F.lit(True).alias("many")), "many")
    n, read = many.count(), rows
    if n:
        marked = rows.join(sized_broadcast(many, n), F.col("id").eqNullSafe(F.col("j")), "left")
        rows = marked.select("id", F.when(F.col("many"), F.xxhash64("text")).otherwise(0).alias("tie"), "text")
        read = rows.where("tie = 0").unionByName(rows.where("tie <> 0").dropDuplicates(["id", "tie"]))
    runs = repeated_windows(read, scratch).distinct().groupBy("id", "tie").agg(F.collect_list(F.struct("p", "n")).alias("own")).withColumnsRenamed({"id": "__i", "tie": "__t"}).hint("merge")
    joined = rows.join(runs, F.col("id").eqNullSafe(F.col("__i")) & (F.col("tie") == F.col("__t")), "left").select(F.col("id").alias("doc_id"), "text", "own")
    schema = f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept_bytes binary" * with_text
    return joined.mapInArrow(lambda it: _remove(it, with_text), schema)
