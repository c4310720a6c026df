"""Numpy kernels over batches of texts, for the operators that run in Arrow batches.

Texts are handled in slices of bounded bytes, so memory follows the slice and
not the batch; a text longer than a slice is hashed piece by piece.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

U = np.uint64
PIECE = 1 << 20
SLICE_BYTES = 4 << 20
#: An odd multiplier.
P = 0x9E3779B97F4A7C15
def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _table(keep, lower: bool) -> bytes:
    t = bytearray(range(256))
    for b in range(256):
        if not keep(b):
            t[b] = 32
        elif lower and 65 <= b <= 90:
            t[b] = b + 32
    return bytes(t)


#: Byte tables that turn separators into spaces: [^\x20\x09-\x0D]+, and [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing A-Z.
PLAIN = _table(lambda b: b not in (32, 9, 10, 11, 12, 13), lower=False)
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
ALNUM = _table(lambda b: b >= 128 or 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122, lower=True)


#: Bytes of a word that are mixed eight at a time; longer words are hashed by xxh3.
SHORT = 64
#: Masks of the first 0 to 8 bytes of a number.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], U)


def _hash_all(buffer: bytes, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes from s to e, of those bytes alone: one to one for up to eight of them of a length."""
    padded = np.frombuffer(buffer + bytes(8), np.uint8)
    eight = np.ndarray(len(buffer) + 1, U, padded.data, strides=(1,))  # the number that begins at each place
    size = e - s
    h = mix(size.astype(U) * U(P))
    live = np.arange(len(s))
    for at in range(0, SHORT, 8):
        live = live[size[live] > at] if at else live
        if not len(live):
            break
        h[live] = mix(h[live] ^ (eight[s[live] + at] & _FIRST[np.minimum(size[live] - at, 8)]))
    for i in np.flatnonzero(size > SHORT):
        h[i] = xxhash.xxh3_64_intdigest(buffer[s[i] : e[i]])
    return h


def word_hashes(data: bytes, table: bytes) -> np.ndarray:
    """A 64-bit hash of each word of UTF-8 bytes."""
    out, at, n = [], 0, len(data)
    while at < n:
        end = min(n, at + PIECE)
        piece = data[at:end].translate(table)
        if end < n:  # end on a separator
            cut = piece.rfind(b" ")
            while cut < 0 and end < n:  # one word longer than a piece
                more = data[end : end + PIECE].translate(table)
                found = more.find(b" ")
                piece += more if found < 0 else more[:found]
                end += len(more) if found < 0 else found
                cut = -1 if found < 0 else len(piece)
            if cut >= 0:
                end, piece = at + max(cut, 1), piece[: max(cut, 1)]
        inside = np.concatenate(([False], np.frombuffer(piece, np.uint8) != 32, [False]))
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        if len(edge):
            out.append(_hash_all(piece, edge[::2], edge[1::2]))
        at = end
    return np.concatenate(out) if out else np.zeros(0, U)


def slices(batch: pa.RecordBatch, text_col: str, most: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Parts of a batch of about so many bytes of text each, with their texts as bytes, null as empty."""
    column = batch.column(text_col)
    size = np.asarray(pc.binary_length(column).fill_null(0)).astype(np.int64)
    at, n = 0, batch.num_rows
    total = np.cumsum(size)
    while at < n:
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + most, "right")))
        part = batch.slice(at, end - at)
        texts = [x or b"" for x in part.column(text_col).cast(pa.large_binary()).to_pylist()]
        yield part, texts
        at = end


def joined_hashes(texts: list[bytes], table: bytes, gap: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes of texts one after another with gap zeros behind each; where each text starts, and its words."""
    each = _each(texts, table)
    counts = np.array([len(x) for x in each], np.int64)
    starts = np.concatenate(([0], np.cumsum(counts + gap)))[:-1]
    out = np.zeros(int((counts + gap).sum()), U)
    if len(each):
        flat = np.concatenate(each)
        at = np.repeat(starts - np.concatenate(([0], np.cumsum(counts)))[:-1], counts) + np.arange(len(flat))
        out[at] = flat
    return out, starts, counts


def _each(texts: list[bytes], table: bytes) -> list[np.ndarray]:
    """Word hashes of each text; short texts are hashed together."""
    out: list[np.ndarray | None] = [None] * len(texts)
    group: list[int] = []
    size = 0

    def flush():
        nonlocal group, size
        if group:
            joined = b" ".join(texts[i] for i in group)
            hashes = word_hashes(joined, table)
            ends = np.cumsum([len(texts[i]) + 1 for i in group])
            a = np.frombuffer(joined.translate(table), np.uint8)
            inside = np.concatenate(([False], a != 32))
            first = np.flatnonzero(inside[1:] & ~inside[:-1])
            cuts = np.searchsorted(first, ends)
            for i, x in zip(group, np.split(hashes, cuts[:-1]), strict=True):
                out[i] = x
        group, size = [], 0

    for i, t in enumerate(texts):
        if len(t) >= PIECE // 2:
            out[i] = word_hashes(t, table)
            continue
        if size + len(t) + 1 > PIECE // 2:
            flush()
        group.append(i)
        size += len(t) + 1
    flush()
    return out


def shingles(words: np.ndarray, starts: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k consecutive words, and the text of each; a text of fewer words, but not none, has one of all."""
    up = [pow(P, 2 * i + 1, 1 << 64) for i in range(k)]
    n = len(words)
    total = np.zeros(n, U)
    for i in range(min(k, n)):
        total[: n - i] += words[i:] * U(up[i])
    number = np.maximum(counts - k + 1, np.minimum(counts, 1))
    text = np.repeat(np.arange(len(counts)), number)
    at = np.repeat(starts - np.concatenate(([0], np.cumsum(number)))[:-1], number) + np.arange(int(number.sum()))
    out = total[at]
    for i in np.flatnonzero((counts > 0) & (counts < k)):
        j = np.searchsorted(text, i)
        own = words[starts[i] : starts[i] + counts[i]]
        out[j] = U(sum(int(w) * u for w, u in zip(own, up)) % (1 << 64)) + U(int(counts[i]))
    return mix(out), text
