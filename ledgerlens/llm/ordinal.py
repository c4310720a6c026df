"""Quality grades by an ordinal cumulative-link regression on hashed text.

P(grade > k) = sigmoid(w.x - t_k): one weight per hashed feature, shared by
all grades, and ordered thresholds t_0 < t_1 < .... Features are the presence
of words (lower-cased) and of pairs of bytes, each over the root of the number
of a text's features, so that length alone doesn't move a grade. All of them
are fitted, by limited-memory quasi-Newton steps on the likelihood with a
ridge. The ridge is weaker for features that are more frequent on one side of
the top grade than on the other: a weight is the product of a fitted number and
the size of the logarithm of that ratio, plus EVEN.

Grades of a label: 0 toxic, 1 bad, 2 good. Null texts and texts without
features get the grade that the thresholds alone give, and so does every
document where there are no labels or one grade only. Repeated rows and labels
count as often as they occur, in the sample of those that are fitted as well:
a label that is there k times is taken k times the sample's rate, rounded by a
hash. Labels without an id meet no document. Texts of any length are read in
parts, a run without spaces as one. A document at KEEP_TAIL is kept. An empty
table of documents gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import Scratch, sized_broadcast, whole
from ledgerlens.llm.kernels import ALNUM, PIECE, joined_hashes, slices

BITS, GRADES = 18, 3
#: About so many labelled rows, and bytes of text, chosen by a hash, are fitted; all if there are fewer, and never more than twice as many rows.
TRAIN_ROWS, TRAIN_BYTES = 12_000, 60_000_000
STEPS, MEMORY, RIDGE, EVEN = 120, 8, 3e-5, 0.05
#: Features that are expanded at once in fitting.
FIT_VALUES = 1_000_000
KEEP_TAIL = 0.5


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, feature) pairs of texts, sorted: words in even buckets, pairs of bytes in odd ones."""
    if len(texts) == 1 and len(texts[0]) > PIECE:
        parts = [features([x])[1] for x in _segments(texts[0])]
        own = np.unique(np.concatenate(parts))
        return np.zeros(len(own), np.int64), own
    words, starts, counts = joined_hashes(texts, ALNUM)
    text = np.repeat(np.arange(len(texts)), counts)
    parts = [text << BITS | (words >> np.uint64(65 - BITS)).astype(np.int64) << 1]
    raw = np.frombuffer(b"\x00".join(texts), np.uint8)
    ends = np.cumsum([len(t) + 1 for t in texts])
    for at in range(0, len(texts), 256):  # a table of what pairs each text has
        begin, end = (int(ends[at - 1]) if at else 0), int(ends[min(at + 256, len(texts)) - 1]) - 1
        own = raw[begin:end]
        seen = np.zeros((min(256, len(texts) - at), 1 << 16), bool)
        size = np.diff(ends[at : at + 256], prepend=begin)
        seen[np.repeat(np.arange(len(size)), size)[: max(0, len(own) - 1)], own[:-1].astype(np.int64) << 8 | own[1:]] = True
        t, p = np.nonzero(seen)
        t += at
        fine = (p & 0xFF != 0) & (p >> 8 != 0)
        parts.append(t[fine] << BITS | ((p[fine] * 0x9E3779B1 >> 7) & ((1 << BITS - 1) - 1)) << 1 | 1)
    both = np.unique(np.concatenate(parts))
    return both >> BITS, both & ((1 << BITS) - 1)


def _segments(data: bytes) -> Iterator[bytes]:
    """A long text in parts of about PIECE bytes that begin and end at a space, so that no word is cut and every pair is in one."""
    at = 0
    while at < len(data):
        end = data.find(b" ", at + PIECE // 2)
        end = len(data) if end < 0 else end + 1
        yield data[max(0, at - 1) : end]
        at = end


class Model:
    """weights: of all features; thresholds: in order."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray):
        self.weights, self.thresholds = weights.astype(np.float32), thresholds

    def tails(self, texts: list[bytes]) -> np.ndarray:
        """Per text: P(grade > k) for each threshold."""
        t, f = features(texts)
        x = np.bincount(t, self.weights[f], minlength=len(texts)) / np.sqrt(np.maximum(np.bincount(t, minlength=len(texts)), 1))
        return 1 / (1 + np.exp(-np.clip(x[:, None] - self.thresholds, -40, 40)))


class Rows:
    """The features of texts one after another, where each text's begin, and the texts' grades."""

    def __init__(self, rows: list[np.ndarray], grades: np.ndarray):
        self.flat = np.concatenate(rows).astype(np.int32) if rows else np.zeros(0, np.int32)
        self.size = np.array([len(r) for r in rows], np.int64)
        self.starts, self.grades = np.concatenate(([0], np.cumsum(self.size))), grades
        self.cuts = np.unique(np.searchsorted(self.starts, np.arange(0, self.starts[-1] + FIT_VALUES, FIT_VALUES), "left").clip(max=len(rows)))
        self.cuts = np.unique(np.concatenate(([0], self.cuts, [len(rows)])))

    def blocks(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Of a block of texts at a time: features, the text of each, grades, and one over the root of each text's size."""
        for a, b in zip(self.cuts, self.cuts[1:]):
            size = self.size[a:b]
            yield self.flat[self.starts[a] : self.starts[b]], np.repeat(np.arange(b - a), size), self.grades[a:b], 1 / np.sqrt(np.maximum(size, 1))


def strength(rows: Rows) -> np.ndarray:
    """Of every feature, EVEN and the absolute logarithm of its smoothed share of texts below the top grade over that of the others."""
    counts = np.zeros((2, 1 << BITS))
    for f, text, y, _ in rows.blocks():
        top = y == GRADES - 1
        for side in (0, 1):
            counts[side] += np.bincount(f[top[text] == side], minlength=1 << BITS)
    n = np.bincount(rows.grades == GRADES - 1, minlength=2)
    shares = (counts + 1) / (n[:, None] + 2)
    return EVEN + np.abs(np.log(shares[0] / shares[1]))


def loss(point: np.ndarray, rows: Rows, scale: np.ndarray, ridge: float = RIDGE) -> tuple[float, np.ndarray]:
    """Mean negative log-likelihood with the ridge, and its gradient, at a point: weights over their scale, the first threshold, logarithms of the gaps."""
    n, k = len(rows.size), GRADES - 1
    gaps, w = point[-k:], point[:-k] * scale
    steps = np.concatenate((gaps[:1], np.exp(gaps[1:])))
    thresholds = np.cumsum(steps)
    value, g_w, g_t = ridge / 2 * float(point[:-k] @ point[:-k]), np.zeros(len(w)), np.zeros(k)
    for f, text, y, share in rows.blocks():
        m = len(y)
        x = np.bincount(text, w[f], minlength=m) * share
        s = 1 / (1 + np.exp(-np.clip(x[:, None] - thresholds, -40, 40)))
        one, none, i = np.ones((m, 1)), np.zeros((m, 1)), np.arange(m)
        p = np.maximum((np.concatenate((one, s), axis=1) - np.concatenate((s, none), axis=1))[i, y], 1e-12)
        slope = np.concatenate((none, s * (1 - s), none), axis=1)
        low, high = slope[i, y] / p, slope[i, y + 1] / p
        value -= float(np.log(p).sum()) / n
        g_w += np.bincount(f, ((high - low) * share / n)[text], minlength=len(w))
        g_t += np.array([low[y == j + 1].sum() - high[y == j].sum() for j in range(k)]) / n
    g_gaps = np.cumsum(g_t[::-1])[::-1] * np.concatenate(([1.0], steps[1:]))
    return value, np.concatenate((g_w * scale + ridge * point[:-k], g_gaps))


def minimise(f, x: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """Limited-memory quasi-Newton steps with backtracking from x on a function that gives its value and gradient."""
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    value, g = f(x)
    for _ in range(steps):
        d, used = -g, []
        for s, y in reversed(pairs):
            used.append((d @ s) / (y @ s))
            d = d - used[-1] * y
        if pairs:
            d = d * ((pairs[-1][0] @ pairs[-1][1]) / (pairs[-1][1] @ pairs[-1][1]))
        for (s, y), a in zip(pairs, reversed(used)):
            d = d + (a - (d @ y) / (y @ s)) * s
        step = 1.0 if pairs else 1 / max(1.0, float(np.abs(g).sum()))
        for _ in range(30):
            following, slope = f(x + step * d)
            if following <= value + 1e-4 * step * (g @ d):
                break
            step /= 2
        else:
            break
        s, y = step * d, slope - g
        if s @ y > 1e-12:
            pairs = [*pairs, (s, y)][-MEMORY:]
        x, value, g = x + s, following, slope
        if np.abs(g).max() < 1e-6:
            break
    return x


def fit(rows: list[np.ndarray], grades: np.ndarray) -> Model:
    """rows: the features of each text; grades: 0 to GRADES - 1."""
    n = len(rows)
    share = np.array([(np.sum(grades > k) + 1) / (n + 2) for k in range(GRADES - 1)])
    thresholds = np.maximum.accumulate(-np.log(share / (1 - share)) + 1e-3 * np.arange(GRADES - 1))
    if n == 0 or grades.std() == 0:
        return Model(np.zeros(1 << BITS), thresholds)
    start = np.concatenate((np.zeros(1 << BITS), thresholds[:1], np.log(np.maximum(np.diff(thresholds), 1e-3))))
    own = Rows(rows, grades)
    scale = strength(own)
    best = minimise(lambda x: loss(x, own, scale), start)
    gaps = best[-(GRADES - 1) :]
    return Model(best[: 1 << BITS] * scale, np.cumsum(np.concatenate((gaps[:1], np.exp(gaps[1:])))))


def train(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, id_col: str = "doc_id") -> Model:
    """Fits a bounded number of labelled documents; their features, not their texts, come to the driver."""
    graded = labels.where("quality is not null").select(F.col(id_col).alias("__id"), F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 1, 2).otherwise(1).cast("long").alias("__grade"))
    graded = graded.groupBy("__id", "__grade").agg(F.count(F.lit(1)).alias("__n"))
    total = graded.agg(F.coalesce(F.sum("__n"), F.lit(0))).first()[0]
    mean = docs.agg(F.avg(F.octet_length(whole(F.col("text"))))).first()[0] or 0.0
    rate = min(1.0, train_rows / max(1, total), TRAIN_BYTES / max(1.0, total * mean))
    chance = F.pmod(F.xxhash64(F.lit("grade"), "__id", "__grade"), F.lit(1_000_000)) / 1e6
    taken = F.floor(F.col("__n") * rate + chance).cast("long") if rate < 1 else F.col("__n")
    graded = Scratch(docs.sparkSession, "grades").keep(graded.select("__id", "__grade", taken.alias("__times")).where("__times > 0"), "graded")

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch, "text"):
                t, f = features(texts)
                cut = np.searchsorted(t, np.arange(len(texts) + 1))
                yield pa.RecordBatch.from_arrays([part.column("__id"), part.column("__grade"), part.column("__h"), pa.array([f[a:b].astype(np.int32).tobytes() for a, b in zip(cut, cut[1:])], pa.binary())], names=["__id", "__grade", "__h", "f"])

    # The sample's ids are few, so texts stay where they are; rows that an id's repeats make beyond it are cut by hash.
    rows = docs.join(sized_broadcast(graded, graded.count()), F.col(id_col) == F.col("__id"))
    rows = rows.select("__id", "__grade", F.explode(F.sequence(F.lit(1), F.least("__times", F.lit(2 * train_rows)).cast("int"))).alias("__time"), "text")
    rows = rows.withColumn("__h", F.xxhash64("__id", "__grade", "__time", "text"))
    chosen = rows.select("__h").orderBy("__h").limit(2 * train_rows).agg(F.count(F.lit(1)), F.max("__h")).first()
    rows = rows.where(F.col("__h") <= F.lit(chosen[1])) if chosen[0] == 2 * train_rows else rows
    kind = dict(labels.dtypes)[id_col]
    own = rows.select("__id", "__grade", "__h", "text").mapInArrow(reduce, f"__id {kind}, __grade long, __h long, f binary").orderBy("__h").limit(2 * train_rows).toArrow()
    return fit([np.frombuffer(x, np.int32) for x in own["f"].to_pylist()], own["__grade"].to_numpy() if own.num_rows else np.zeros(0, np.int64))


def grade(docs: DataFrame, model: Model, id_col: str = "doc_id") -> DataFrame:
    """Per document: id, expected_grade, p_middle (grade 1 or more), p_top (the highest), kept (p_top of KEEP_TAIL or more)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for part, texts in slices(batch, "__text"):
                tails = shared.value.tails(texts)
                columns = [tails.sum(axis=1), tails[:, 0], tails[:, -1], tails[:, -1] >= KEEP_TAIL]
                yield pa.RecordBatch.from_arrays([part.column(id_col), *map(pa.array, columns)], names=[id_col, "expected_grade", "p_middle", "p_top", "kept"])

    return docs.select(id_col, F.col("text").alias("__text")).mapInArrow(run, f"`{id_col}` {dict(docs.dtypes)[id_col]}, expected_grade double, p_middle double, p_top double, kept boolean")
