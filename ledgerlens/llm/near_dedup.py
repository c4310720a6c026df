"""Near-duplicates by BagMinHash signatures, banding and verified multiset overlap.

A text is a multiset of five-word shingles. Signatures are those of weighted
Jaccard similarity on the multiplicities: each shingle owns Poisson processes
over time, one for each dyadic slice [0,1), [1,2), [2,4), [4,8) ... of its
weight, with a rate equal to the slice's width; a point falls on a signature
component and at a height within its slice, and counts if the height is below
the weight. A component's value is its earliest point, so two texts agree in a
component with the probability of their weighted Jaccard similarity, and
points are only drawn up to the time by which all components have one.

Texts with the same words form exact classes first, by a sum over a hash, and
one member of each goes on. Members of a band's bucket are linked by a
maximum spanning forest of estimated similarity, in chunks of bounded size
whose roots meet in further rounds, so that links stay linear in members.
Every link is then verified by exact multiset overlap of the two texts, and
components of the links are found by rounds of large and small stars on
written tables. The forest is only a short cut: where members of a bucket are
still in different components, all their pairs of estimate MAYBE or more are
compared too unless links have connected them by then, in cells of two blocks
of bounded size that give a spanning forest of what they verify, and the
components of both kinds of links are the classes. A bucket of more than LARGE
blocks is refined first: a pair of estimate MAYBE agrees in 77 of 120
components, so if each member lists the 44 of its components that are rarest
in the bucket, in one order for all, such a pair meets in a listed one, and is
compared at the first of them only. Passages that all members of a bucket share
are their common components and bring nobody together, so unlike members cost
44 short rows each; only where members agree in more than 76 components with
most others, without being linked, do the cells grow with the square. No
group of documents is held by one task or the driver.

Texts are known by a hash of their words, not by their ids, so rows without an
id and rows that repeat one are classed by their words like others. The class
id is the smallest id of a class, null if none has one. Texts without words are
alone. Texts of fewer words than a shingle have one shingle of all their words.
Of rows that are equal in id and text, first_of_class keeps one. Empty tables
give empty results; other columns are ignored, or pass through first_of_class,
for whose own use are names that begin with two underscores.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import Scratch
from ledgerlens.llm.kernels import PLAIN, U, joined_hashes, mix, shingles, slices

WORDS, SIMILAR = 5, 0.8
BANDS, ROWS = 20, 6
M = BANDS * ROWS
#: Estimates below MAYBE are not verified: 0.8 less about 4.5 standard deviations. From SURE on, forests link to the bucket's first member.
MAYBE, SURE = 0.64, 0.88
#: Members of a bucket that are compared with each other at once, and links that share one copy of a text.
CHUNK, SHARE = 256, 64
#: Members, and shingles, of a block of a bucket that is searched pair by pair.
BLOCK, BLOCK_SHINGLES = 512, 1_000_000
#: Blocks above which a bucket is refined; members whose components are counted at once; a component is common if a RARE-th of the members agree in it.
LARGE, TALLY, RARE = 4, 4096, 256
#: Components that a member lists: two signatures that agree in MAYBE of them can't differ in all of these.
PREFIX = M - int(np.ceil(MAYBE * M)) + 1


def bag_shingles(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of texts, and the text of each."""
    words, starts, counts = joined_hashes(texts, PLAIN)
    return shingles(words, starts, counts, WORDS)


def bag_minhash(hashes: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    """Signatures (n x M of 64-bit values) of texts given by shingle hashes grouped by text; no shingles give zeros."""
    out = np.zeros((n, M), U)
    if not len(hashes):
        return out
    order = np.argsort((text.astype(U) << U(44)) | (hashes >> U(20)), kind="stable")
    x, t = hashes[order], text[order]
    new = np.flatnonzero(np.concatenate(([True], (x[1:] != x[:-1]) | (t[1:] != t[:-1]))))
    weight = np.diff(np.append(new, len(x)))
    x, t = x[new], t[new]
    total = np.bincount(t, weight, minlength=n)
    parts = [(x, t, weight, np.zeros(len(x)), np.ones(len(x)))]
    low = 1
    while (own := weight > low).any():  # the slice [low, 2 low)
        level = U(0xA24BAED4963EE407 * low % (1 << 64))
        parts.append((mix(x[own] + level), t[own], weight[own], np.full(own.sum(), float(low)), np.full(own.sum(), float(low))))
        low *= 2
    base, t, weight, start, width = (np.concatenate(c) for c in zip(*parts))
    base = mix(base)
    bound = M / np.maximum(total, 1) * np.log(M / 0.01)
    times = np.full((n, M), np.inf)
    todo = np.arange(n)[total > 0]
    while len(todo):
        live = np.flatnonzero(np.isin(t, todo)) if len(todo) < n else np.arange(len(t))
        at, step = np.zeros(len(live)), 0
        while len(live):
            step += 1
            h = mix(base[live] + U(step * 0x9FB21C651E98DF25 % (1 << 64)))
            at = at - np.log(((h >> U(11)).astype(float) + 0.5) * 2.0**-53) / width[live]
            fine = at <= bound[t[live]]
            live, at, h = live[fine], at[fine], h[fine]
            g = mix(h)
            counts = start[live] + (g >> U(11)).astype(float) * 2.0**-53 * width[live] < weight[live]
            np.minimum.at(times, (t[live[counts]], ((g & U(0x7FF)) * U(M) >> U(11)).astype(np.int64)[counts]), at[counts])
        todo = todo[np.isinf(times[todo]).any(axis=1)]
        bound[todo] *= 4
    filled = total > 0
    out[filled] = mix(times[filled].view(U))
    return out


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    up = np.array([pow(0x9E3779B97F4A7C15, 2 * i + 1, 1 << 64) for i in range(ROWS)], U)
    for batch in batches:
        for part, texts in slices(batch, "text"):
            hashes, text = bag_shingles(texts)
            own = bag_minhash(hashes, text, len(texts))
            keys = mix((own.reshape(-1, BANDS, ROWS) * up).sum(axis=2, dtype=U) + np.arange(BANDS, dtype=U))
            plain = [b" ".join(t.translate(PLAIN).split()) for t in texts]
            columns = [
                pa.array([xxhash.xxh3_128_digest(p) if p else None for p in plain], pa.binary()), pa.array([x.tobytes() for x in own.astype(np.uint16)], pa.binary()),
                pa.array(list(keys.view(np.int64)), pa.list_(pa.int64())), pa.array(np.bincount(text, minlength=len(texts)), pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("h"), *columns], names=["id", "h", "words", "sig", "keys", "size"])


def forest(sigs: np.ndarray) -> list[tuple[int, int]]:
    """Links (parent, child) of a maximum spanning forest of estimated similarity, none below MAYBE."""
    n = len(sigs)
    first = (sigs[1:] == sigs[0]).mean(axis=1)
    links = [(0, int(i) + 1) for i in np.flatnonzero(first >= SURE)]
    rest = np.concatenate(([0], np.flatnonzero(first < SURE) + 1))
    if len(rest) < 2 or n == 2:
        return links + ([(0, 1)] if n == 2 and MAYBE <= first[0] < SURE else [])
    own = sigs[rest]
    best, parent, free = np.full(len(rest), -1.0), np.full(len(rest), -1), np.ones(len(rest), bool)
    now = 0
    for _ in range(len(rest)):
        free[now] = False
        if best[now] >= MAYBE:
            links.append((int(rest[parent[now]]), int(rest[now])))
        close = (own == own[now]).mean(axis=1)
        better = free & (close > best)
        best[better], parent[better] = close[better], now
        if not free.any():
            break
        now = int(np.where(free, best, -2).argmax())
    return links


def _link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, chunk, whole, node, sig), sorted: links within each chunk, and roots of its trees if it isn't the whole bucket."""
    names = ["key", "a", "b", "sig"]
    kept: list[tuple] = []
    now = None

    def done(rows):
        sigs = np.frombuffer(b"".join(r[4] for r in rows), np.uint16).reshape(len(rows), M)
        links = forest(sigs) if len(rows) > 1 else []
        out = [(None, min(rows[i][3], rows[j][3]), max(rows[i][3], rows[j][3]), None) for i, j in links]
        if not rows[0][2]:
            children = {j for _, j in links}
            out += [(r[0], r[3], None, r[4]) for i, r in enumerate(rows) if i not in children]
        return out

    kinds = [pa.int64(), None, None, pa.binary()]
    for batch in batches:
        kinds[1] = kinds[2] = batch.schema.field("node").type
        out: list[tuple] = []
        for r in zip(*(batch.column(c).to_pylist() for c in ("key", "chunk", "whole", "node", "sig"))):
            if r[:2] != now and kept:
                out += done(kept)
                kept = []
            now = r[:2]
            kept.append(r)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [()] * 4, kinds)], names=names)
    out = done(kept) if kept else []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)


def overlap(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard similarity of two multisets of shingles."""
    x, n = np.unique(a, return_counts=True)
    y, k = np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    both = np.minimum(n[i], k[j]).sum()
    return both / max(1, len(a) + len(b) - both)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last: tuple = (None, None)
    for batch in batches:
        ids, texts = batch.column("a").to_pylist(), batch.column("ta")
        other, fine = batch.column("tb"), []
        for i, a in enumerate(ids):
            if a != last[0]:
                last = (a, bag_shingles([(texts[i].as_py() or "").encode()])[0])
            fine.append(overlap(last[1], bag_shingles([(other[i].as_py() or "").encode()])[0]) >= SIMILAR)
        yield batch.select(["a", "b"]).filter(pa.array(fine, pa.bool_()))


def _bucket_links(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """Links (a, b) among rows (key, node, sig) of the same key."""
    links, turn, before = None, 0, None
    while True:
        sizes = scratch.keep(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), f"sizes{turn}")  # written, so that a join can split hot keys
        chunks = F.ceil(F.col("n") / CHUNK)
        chunk = F.pmod(F.xxhash64(F.lit(turn), "node"), chunks)
        own = rows.join(sizes, "key").select("key", chunk.alias("chunk"), (chunks == 1).alias("whole"), "node", "sig")
        ordered = own.repartition("key", "chunk").sortWithinPartitions("key", "chunk", "node")
        made = scratch.keep(ordered.mapInArrow(_link, "key long, a binary, b binary, sig binary"), f"links{turn}")
        found = made.where("b is not null").select("a", "b")
        links = found if links is None else links.unionByName(found)
        rows = made.where("b is null").select("key", F.col("a").alias("node"), "sig")
        left = rows.count()
        if not left:
            return links.distinct()
        if before is not None and left > 0.7 * before:  # many unlike texts in a bucket: four longer keys instead of one
            longer = [F.xxhash64(F.col("key"), F.lit(j), F.substring("sig", 1 + 2 * 7 * (j + 4 * turn) % (2 * M - 10), 8)) for j in range(4)]
            rows, left = rows.select(F.explode(F.array(*longer)).alias("key"), "node", "sig"), None
        before, turn = left, turn + 1


def _groups(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[tuple[pa.Schema, list[tuple]]]:
    """Runs of rows that agree in the first n columns."""
    kept: list[tuple] = []
    schema = None
    for batch in batches:
        schema = batch.schema
        for r in zip(*(c.to_pylist() for c in batch.columns)):
            if kept and r[:n] != kept[0][:n]:
                yield schema, kept
                kept = []
            kept.append(r)
    if kept:
        yield schema, kept


def unlike_pairs(rows: list[tuple]) -> Iterator[tuple[int, np.ndarray]]:
    """Each of a cell's rows (key, i, j, block, node, root, size, seen, sig, ...) and later rows in other components that may be SIMILAR to it, but for those met at a component in seen."""
    root = _codes([r[5] for r in rows])
    block, size = np.array([r[3] for r in rows]), np.array([r[6] for r in rows])
    sigs = np.frombuffer(b"".join(r[8] for r in rows), np.uint16).reshape(len(rows), M)
    for p in range(len(rows) - 1 if root.any() else 0):
        q = slice(p + 1, None)
        fine = (root[q] != root[p]) & (np.minimum(size[q], size[p]) >= SIMILAR * np.maximum(size[q], size[p]) - 1e-6)  # no similarity exceeds the ratio of sizes
        if rows[p][1] != rows[p][2]:
            fine &= block[q] != block[p]
        at = np.flatnonzero(fine) + p + 1
        agree = sigs[at] == sigs[p]
        close = agree.mean(axis=1) >= MAYBE
        if rows[p][7] is not None:
            close &= ~(agree & np.unpackbits(np.frombuffer(rows[p][7], np.uint8))[:M].astype(bool)).any(axis=1)
        at = at[close]
        if len(at):
            yield p, at


def _codes(names: list) -> np.ndarray:
    codes: dict = {}
    return np.array([codes.setdefault(n, len(codes)) for n in names])


def _unlike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of each cell that are in any of its unlike_pairs()."""
    for schema, rows in _groups(batches, 3):
        has = np.zeros(len(rows), bool)
        for p, at in unlike_pairs(rows):
            has[p] = has[at] = True
        if has.any():
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*(rows[i] for i in np.flatnonzero(has))), schema)], schema=schema)


def cell_links(rows: list[tuple]) -> list[tuple]:
    """SIMILAR pairs (a, b) of a cell's rows with their texts, that connect what all such pairs connect."""
    root = _codes([r[5] for r in rows])
    bags = [np.unique(bag_shingles([(r[9] or "").encode()])[0], return_counts=True) for r in rows]
    out = []
    for p, at in unlike_pairs(rows):
        x, k = bags[p]
        for q in at:
            if root[p] == root[q]:
                continue
            y, m = bags[q]
            i = np.minimum(np.searchsorted(x, y), len(x) - 1)
            both = np.where(x[i] == y, np.minimum(k[i], m), 0).sum()
            if both / (k.sum() + m.sum() - both) >= SIMILAR:
                out.append((min(rows[p][4], rows[q][4]), max(rows[p][4], rows[q][4])))
                root[root == root[q]] = root[p]
    return out


def _verify_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for schema, rows in _groups(batches, 3):
        found = cell_links(rows)
        if found:
            kind = schema.field("node").type
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c in zip(*found)], names=["a", "b"])


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each chunk (key, chunk) of rows (..., sig): the component values that are common in it, with their counts."""
    for _, rows in _groups(batches, 2):
        values, n = np.unique(component_values([r[-1] for r in rows]), return_counts=True)
        often = n > max(1, len(rows) // RARE)
        yield pa.RecordBatch.from_arrays([pa.array([rows[0][0]] * int(often.sum()), pa.int64()), pa.array(values[often]), pa.array(n[often])], names=["key", "value", "n"])


def component_values(sigs: list[bytes]) -> np.ndarray:
    """A row per signature: its components' values, with their places."""
    return np.frombuffer(b"".join(sigs), np.uint16).reshape(len(sigs), M) + (np.arange(M) << 16)


def rarest(values: np.ndarray, common: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per row of component values: the PREFIX of least count, and for each a mask of the components before it."""
    n, weight = len(values), np.zeros(values.shape, np.int64)
    if len(common):
        order = np.argsort(common)
        at = np.minimum(np.searchsorted(common[order], values), len(common) - 1)
        weight = np.where(common[order][at] == values, counts[order][at], 0)
    first = np.argsort((weight << 23) + values, axis=1)[:, :PREFIX]
    seen = np.zeros((n, PREFIX, M), bool)
    for i in range(1, PREFIX):
        seen[:, i] = seen[:, i - 1]
        seen[np.arange(n), i, first[:, i - 1]] = True
    return np.take_along_axis(values, first, 1), np.packbits(seen, axis=2)


def _listed(members: pa.Table, common: pa.Table) -> pa.Table:
    """The rows of a chunk of members once for each component that they list."""
    values, seen = rarest(component_values(members.column("sig").to_pylist()), common.column("value").to_numpy(), common.column("total").to_numpy())
    rows = members.select(["key", "node", "root", "size"]).take(pa.array(np.repeat(np.arange(len(values)), PREFIX)))
    return rows.append_column("value", pa.array(values.ravel())).append_column("seen", pa.array([x.tobytes() for x in seen.reshape(-1, seen.shape[2])], pa.binary()))


def _refined(own: DataFrame, large: DataFrame, members: DataFrame, scratch: Scratch) -> DataFrame:
    """Rows (key, node, root, size, seen) of large buckets, under a key for each component that a member lists and another one may share."""
    chunks = F.ceil(F.col("n") / TALLY)
    rows = own.join(large.select("key", "n"), "key").join(members.select("node", "sig"), "node")
    rows = scratch.keep(rows.select("key", F.pmod(F.xxhash64(F.lit("tally"), "node"), chunks).alias("chunk"), "node", "root", "size", "sig"), "large")
    chunk = ["key", "chunk"]
    common = rows.repartition(*chunk).sortWithinPartitions(*chunk).mapInArrow(_tally, "key long, value long, n long")
    common = common.groupBy("key", "value").agg(F.sum("n").alias("total")).join(large.select("key", "n"), "key")
    common = scratch.keep(common.where(F.col("total") * RARE >= F.col("n")).select("key", "value", "total", chunks.alias("chunks")), "common")  # at most M * RARE of a bucket
    every = common.select("key", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk"), "value", "total")
    listed = rows.groupBy(*chunk).cogroup(every.groupBy(*chunk)).applyInArrow(_listed, "key long, node binary, root binary, size long, value long, seen binary")
    return scratch.keep(listed.select(F.xxhash64("key", "value").alias("key"), "node", "root", "size", "seen"), "listed")


def _unlike_buckets(own: DataFrame, least: int) -> DataFrame:
    """Keys of over `least` members that aren't all in one component, with their members and blocks."""
    blocks = F.ceil(F.greatest(F.col("n") / BLOCK, F.col("total") / BLOCK_SHINGLES))
    sizes = own.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("total"), F.min("root").alias("low"), F.max("root").alias("high"))
    return sizes.where((F.col("n") > least) & (F.col("low") != F.col("high"))).select("key", "n", blocks.alias("blocks"))


def _across(rows: DataFrame, members: DataFrame, roots: DataFrame, docs: DataFrame, scratch: Scratch) -> DataFrame:
    """Verified links between members of a bucket that links haven't connected: of rows (key, node), with members' sig and size."""
    own = rows.join(members.select("node", "size"), "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    own = scratch.keep(own.select("key", "node", "root", "size"), "rooted")
    sizes = scratch.keep(_unlike_buckets(own, 2), "unlike")  # two members were compared; written, so that a join can split hot keys
    large = sizes.where(F.col("blocks") > LARGE)
    cells = own.withColumn("seen", F.lit(None).cast("binary")).join(sizes.where(F.col("blocks") <= LARGE), "key")
    if not large.isEmpty():
        listed = _refined(own, large, members, scratch)
        cells = cells.unionByName(listed.join(scratch.keep(_unlike_buckets(listed, 1), "met"), "key"))
    block, other = F.pmod(F.xxhash64(F.lit("block"), "node"), F.col("blocks")), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    cells = cells.join(members.select("node", "sig"), "node").withColumn("block", block).withColumn("other", other)
    cells = cells.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "root", "size", "seen", "sig")
    cell = ["key", "i", "j"]
    found = cells.repartition(*cell).sortWithinPartitions(*cell).mapInArrow(_unlike, cells.schema)
    found = scratch.keep(found, "unlikerows")
    scratch.drop("rooted", "large", "common", "listed")
    used = scratch.keep(_texts(found.select("node").distinct(), members, docs), "unliketexts")
    full = found.join(used, "node").select(*cells.columns, "text")
    across = scratch.keep(full.repartition(*cell).sortWithinPartitions(*cell).mapInArrow(_verify_cells, "a binary, b binary"), "across")
    scratch.drop("unlike", "met", "unlikerows", "unliketexts")
    return across


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) for every node of links (a, b): root is the smallest node of its component."""
    now = scratch.keep(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "star0")
    mark, turn = None, 0
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = scratch.keep(large, f"large{turn}")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.greatest("b", "m").alias("x"), "m").unionByName(least.select(F.col("a").alias("x"), "m")).where("x <> m").select(F.col("x").alias("a"), F.col("m").alias("b")).distinct()
        following = scratch.keep(small, f"star{turn + 1}")
        scratch.drop(f"large{turn}", f"star{turn}")
        now, turn = following, turn + 1
        check = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == tuple(check):
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        mark = tuple(check)


def _texts(nodes: DataFrame, members: DataFrame, docs: DataFrame) -> DataFrame:
    """(node, text) of nodes, each by the row of its first member."""
    first = nodes.join(members.select("node", F.col("first.id").alias("i"), F.col("first.h").alias("g")), "node")
    rows = docs.join(first.hint("merge"), F.col("id").eqNullSafe(F.col("i")) & (F.col("h") == F.col("g")))  # the same plan at every size
    return rows.select("node", "text").dropDuplicates(["node"])


def _judged(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Per row: id, h (a hash of the text), words, class_id, and whether its class keeps it."""
    scratch = Scratch(docs.sparkSession, "near")
    kind = dict(docs.dtypes)[id_col]
    own = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"))
    signed = scratch.keep(own.mapInArrow(_sign, f"id {kind}, h long, words binary, sig binary, keys array<long>, size long"), "signed")
    first = F.struct(F.col("id").isNull().alias("none"), "id", "h")
    exact = signed.where("words is not null").groupBy(F.col("words").alias("node")).agg(F.min(first).alias("first"), F.min("sig").alias("sig"), F.min("keys").alias("keys"), F.min("size").alias("size"))  # equal words have equal signatures
    exact = scratch.keep(exact, "exact")
    rows = exact.select(F.explode("keys").alias("key"), "node")
    shared = scratch.keep(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key"), "keys")
    rows = scratch.keep(rows.join(shared, "key"), "shared")
    links = scratch.keep(_bucket_links(rows.join(exact.select("node", "sig"), "node"), scratch), "links")
    roots = components(scratch.keep(_verified(links, exact, own, scratch), "verified"), scratch)
    scratch.drop("keys", "links", "ends", "used")
    more = _across(rows, exact.select("node", "first", "sig", "size"), roots, own, scratch)
    if not more.isEmpty():
        again = Scratch(docs.sparkSession, "near-again")
        roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more), again)
    nodes = scratch.keep(exact.select("node", "first").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "nodes")
    scratch.drop("shared", "exact", "across", "verified")
    best = nodes.groupBy("root").agg(F.min("first").alias("best"))
    nodes = nodes.join(best, "root").select(F.col("node").alias("words"), "best")
    rows = signed.select("id", "h", "words").join(nodes, "words", "left")
    alone = F.col("words").isNull()
    return rows.select("id", "h", "words", F.when(alone, F.col("id")).otherwise(F.col("best.id")).alias("class_id"), (alone | (first == F.col("best"))).alias("kept"))


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, class_id (the smallest id of its class) and kept (it is the row that stays, or equal to it)."""
    return _judged(docs, id_col, text_col).select(F.col("id").alias(id_col), "class_id", "kept")


def _verified(links: DataFrame, members: DataFrame, docs: DataFrame, scratch: Scratch) -> DataFrame:
    """The links of SIMILAR or more. A text with many links is copied once for every SHARE of them, so none is hot."""
    many = links.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / SHARE).alias("n"))
    ends = scratch.keep(links.select(F.col("b").alias("node")).unionByName(links.select(F.col("a").alias("node"))).distinct(), "ends")
    used = scratch.keep(_texts(ends, members, docs), "used")
    left = links.join(many, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("n")).alias("copy")).join(used.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b")
    right = many.join(used.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a").select("a", "ta", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("copy"))
    return left.join(right, ["a", "copy"]).select("a", "b", "ta", "tb").mapInArrow(_verify, "a binary, b binary")


def first_of_class(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, with all their columns, without all but the first of each class: that of the smallest id, by a hash of the text at ties."""
    judged = _judged(docs, id_col, text_col).groupBy(F.col("id").alias("__i"), F.col("h").alias("__h")).agg(F.max("kept").alias("kept"), F.count("words").alias("n"))
    judged = Scratch(docs.sparkSession, "kept").keep(judged, "judged")
    same = F.col(f"`{id_col}`").eqNullSafe(F.col("__i")) & (F.xxhash64(text_col) == F.col("__h"))
    out = docs.join(judged.where("not kept").select("__i", "__h").hint("merge"), same, "left_anti")  # the same plan at every size
    again = judged.where("kept and n > 1").select("__i", "__h")
    if again.isEmpty():
        return out
    single = out.join(again.hint("merge"), same, "left_semi").dropDuplicates([id_col, text_col])
    return out.join(again.hint("merge"), same, "left_anti").unionByName(single)
