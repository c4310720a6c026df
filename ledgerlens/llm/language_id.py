"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts n-grams of labelled texts by language and bucket; the
log-probability matrix (languages x buckets) is broadcast, and batches of texts
are scored by gathering its rows and summing them per text.

Null texts and texts without a letter are und with score 0. Without labels
every text is und. Ties go to the first language in order. Repeated rows count
as often as they occur. Languages are scored in blocks of BLOCK_LANGUAGES, a
matrix of 64 MB each; where there are more, texts are written with the best
language so far between blocks, so there is no most number of them. Rows
without an id are not held out. An empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import Scratch
from ledgerlens.llm.kernels import slices

ORDERS, BITS = (2, 3), 16
BUCKETS = len(ORDERS) << BITS
SMOOTH = 0.5
#: About so many labelled rows, chosen by a hash of the id, are learned from; all if there are fewer.
TRAIN_ROWS = 60_000
#: So many languages make a matrix of 64 MB.
BLOCK_LANGUAGES = 128
#: Characters of a text that are hashed at once.
PIECE_CHARS = 1 << 20
MULTIPLIERS = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the n-grams of texts (one array per order, row after row), where each text starts, and whether it has a letter."""
    lowered = [t.decode("utf-8", "replace").lower() for t in texts]
    padded = [f" {t}   " for t in lowered]
    starts = np.concatenate(([0], np.cumsum([len(t) for t in padded])))[:-1].astype(np.int64)
    return _buckets("".join(padded)), starts, np.array([_has_letter(t) for t in lowered], bool)


def _buckets(text: str) -> np.ndarray:
    """The bucket of the n-gram from each character on, one row per order."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    out = []
    for k, n in enumerate(ORDERS):
        h = np.zeros(len(c), np.uint32)
        for i in range(n):
            h[: len(c) - i] = (h[: len(c) - i] ^ c[i:]) * np.uint32(MULTIPLIERS[i])
            h ^= h >> np.uint32(15)
        out.append((h >> np.uint32(32 - BITS)).astype(np.int64) + (k << BITS))
    return np.stack(out) if len(c) else np.zeros((len(ORDERS), 0), np.int64)


def _long_parts(text: bytes) -> tuple[Iterator[np.ndarray], bool]:
    """grams() of a long text, part after part."""
    lowered = text.decode("utf-8", "replace").lower()
    padded, more = f" {lowered}   ", max(ORDERS) - 1

    def parts():
        for at in range(0, len(padded), PIECE_CHARS):
            end = min(len(padded), at + PIECE_CHARS)
            yield _buckets(padded[at : end + more])[:, : end - at]

    return parts(), _has_letter(lowered)


def _has_letter(text: str) -> bool:
    return text[:200].isalpha() or any(map(str.isalpha, text))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        for part, texts in slices(batch, "text"):
            langs = np.array(part.column("lang").to_pylist(), object)
            for lang in sorted(set(langs)):
                own = [t for t, x in zip(texts, langs) if x == lang]
                for found in _long_parts(own[0])[0] if len(own) == 1 else [grams(own)[0]]:
                    total[lang] = total.get(lang, 0) + np.bincount(found.ravel(), minlength=BUCKETS)
    for lang, counts in total.items():
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(counts[at], pa.int64())], names=["lang", "bucket", "n"])


class Block:
    """Some languages, in order; table: buckets x languages of log probabilities; prior: log shares of texts among those of all languages."""

    def __init__(self, languages: list[str], counts: np.ndarray, prior: np.ndarray):
        self.languages, self.prior = languages, prior
        per_order = (counts + SMOOTH).reshape(len(languages), len(ORDERS), 1 << BITS)
        self.table = np.log(per_order / per_order.sum(axis=2, keepdims=True)).reshape(len(languages), BUCKETS).T.astype(np.float32).copy()

    def logs(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Log probabilities of texts with each language, and whether they have a letter."""
        if len(texts) == 1:
            parts, letter = _long_parts(texts[0])
            return self.prior + sum(self.table[row].sum(axis=0, dtype=np.float64) for part in parts for row in part)[None], np.array([letter])
        buckets, starts, letters = grams(texts)
        return self.prior + sum(np.add.reduceat(self.table[row], starts, axis=0, dtype=np.float64) for row in buckets), letters


class Model:
    """languages: in order, with their numbers of texts; counts: a written table of lang, bucket and n."""

    def __init__(self, languages: list[str], texts: np.ndarray, counts: DataFrame | None):
        self.languages, self.texts, self.counts = languages, texts, counts

    def blocks(self, size: int = BLOCK_LANGUAGES) -> Iterator[Block]:
        prior = np.log(self.texts / max(1, self.texts.sum()))
        for at in range(0, len(self.languages), size):
            own = self.languages[at : at + size]
            where, counts = {x: i for i, x in enumerate(own)}, np.zeros((len(own), BUCKETS))
            found = self.counts.where((F.col("lang") >= own[0]) & (F.col("lang") <= own[-1])).toArrow()  # at most languages of a block x buckets rows
            if found.num_rows:
                counts[np.array([where[x] for x in found["lang"].to_pylist()]), found["bucket"].to_numpy()] = found["n"].to_numpy()
            yield Block(own, counts, prior[at : at + size])


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, train_rows: int = TRAIN_ROWS) -> Model:
    """docs: doc_id, text and lang; rows with a null text or lang teach nothing."""
    own = docs.select("doc_id", "text", "lang").where("lang is not null and text is not null")
    by = {r.lang: r.n for r in own.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per language
    if not by:
        return Model([], np.zeros(0), None)
    total = sum(by.values())
    if total > train_rows:
        own = own.where(F.pmod(F.xxhash64(F.lit("language"), "doc_id", F.crc32(F.col("text").cast("binary"))), F.lit(1_000_000)) < int(1e6 * train_rows / total))
    languages = sorted(by, key=str.encode)
    found = own.select("text", "lang").mapInArrow(_count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    return Model(languages, np.array([by[x] for x in languages], float), Scratch(docs.sparkSession, "language").keep(found, "counts"))


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", keep: tuple[str, ...] = (), block: int = BLOCK_LANGUAGES) -> DataFrame:
    """Per document: id, keep, lang_pred and score. Only the text is looked at."""
    spark, kinds, own = docs.sparkSession, dict(docs.dtypes), [id_col, *keep]
    rows = docs.select(*own, F.col("text").alias("__text"))
    if not model.languages:
        return rows.select(*own, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    scratch, state = Scratch(spark, "languages"), ["__lang", "__best", "__all"]
    rows = rows.select("*", F.lit(None).cast("string").alias("__lang"), F.lit(float("-inf")).alias("__best"), F.lit(float("-inf")).alias("__all"))
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in own) + ", __text string, __lang string, __best double, __all double"
    blocks = -(-len(model.languages) // block)

    def scored(rows: DataFrame, shared, last: bool) -> DataFrame:
        """rows with the best language so far, its log probability, and that of all languages so far; without the text if last."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part, texts in slices(batch, "__text"):
                    if not texts:
                        continue
                    logs, letters = shared.value.logs(texts)
                    top = logs.max(axis=1)
                    best, whole = np.asarray(part.column("__best")), np.asarray(part.column("__all"))
                    better = top > best
                    names = np.where(better, np.array(shared.value.languages, object)[logs.argmax(axis=1)], np.array(part.column("__lang").to_pylist(), object))
                    names[~letters] = None
                    whole = np.logaddexp(whole, top + np.log(np.exp(logs - top[:, None]).sum(axis=1)))
                    columns = {c: part.column(c) for c in own} | ({} if last else {"__text": part.column("__text")})
                    columns |= {"__lang": pa.array(names, pa.string()), "__best": pa.array(np.maximum(best, top)), "__all": pa.array(whole)}
                    yield pa.RecordBatch.from_pydict(columns)

        return rows.mapInArrow(run, schema.replace("__text string, ", "") if last else schema)

    for i, one in enumerate(model.blocks(block)):
        shared = spark.sparkContext.broadcast(one)
        rows = scored(rows, shared, i + 1 == blocks)
        if i + 1 < blocks:
            rows = scratch.keep(rows, f"block{i}")
            shared.destroy()
            scratch.drop(f"block{i - 1}")
    named = F.col("__lang").isNotNull()
    return rows.select(*own, F.coalesce("__lang", F.lit("und")).alias("lang_pred"), F.when(named, F.least(F.lit(1.0), F.exp(F.col("__best") - F.col("__all")))).otherwise(0.0).alias("score"))
