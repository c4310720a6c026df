"""Repeated strings and near-duplicates, compared with brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import near_dedup, suffix_dedup
from ledgerlens.llm.kernels import PLAIN, word_hashes
from tests.llm.cases import awkward, empty

DATA = "/root/testdata/sf0.001"


# -- repeated strings --------------------------------------------------------------------------
def removed(rows, length=100):
    seen, out = set(), []
    for d, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        b = (text or "").encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            w = b[i : i + length]
            if w in seen:
                gone[i : i + length] = True
            else:
                seen.add(w)
        edges = np.diff(np.concatenate(([0], gone.astype(int), [0])))
        kept = bytes(np.frombuffer(b, np.uint8)[~gone]) if len(b) else b""
        out.append((d, len(b), int(gone.sum()), int((edges == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def made_up(seed, n=60):
    """Texts that share passages of lengths about the limit, low-complexity runs, and copies."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7)))
    passages = ["".join(word() + " " for _ in range(rng.randint(12, 60))) for _ in range(8)] + ["z" * 150, "ab" * 90, "\n" * 120]
    texts = []
    for _ in range(n):
        parts = []
        for _ in range(rng.randint(0, 6)):
            p = rng.choice(passages)
            a, b = sorted((rng.randrange(len(p)), rng.randrange(len(p))))
            parts += [p[a:b] if rng.random() < 0.6 else p, "".join(word() + " " for _ in range(rng.randint(0, 12)))]
        texts.append("".join(parts))
    return texts + texts[:5] + [None, ""]


@pytest.mark.parametrize("split", [1000, 2])
def test_removal_matches_brute_force(spark, monkeypatch, split):
    """Anchors in whole, and those of over two pieces split on longer strings."""
    monkeypatch.setattr(suffix_dedup, "SPLIT", split)
    rows = list(enumerate(made_up(split)))
    random.Random(1).shuffle(rows)
    got = suffix_dedup.without_repeats(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, got.collect())) == sorted(removed(rows))


def test_removal_in_segments_and_blocks(spark, monkeypatch):
    """Texts longer than a segment, and anchors in many blocks."""
    monkeypatch.setattr(suffix_dedup, "SLICE_BYTES", 150)
    monkeypatch.setattr(suffix_dedup, "BLOCK", 200)
    texts = made_up(7, 20)
    rows = list(enumerate(["".join(x or "" for x in texts), *texts]))
    batches = [pa.RecordBatch.from_arrays([pa.array([i]), pa.array([0]), pa.array([t or ""])], names=["id", "tie", "text"]) for i, t in rows]
    parts = [b for batch in batches for b in suffix_dedup._anchors(iter([batch])) if b.num_rows]
    found = {(r["id"], r["p"] + k, r["p"] + r["off"]) for b in parts for r in b.to_pylist() for k in range(r["n"])}
    assert len(found) == sum(max(0, len((t or "").encode()) - 99) for _, t in rows)
    got = {(r["id"], r["p"]) for b in suffix_dedup._block_repeats(iter([_sorted_pieces(parts, dict(rows))])) for r in _windows(b)}
    seen, want = set(), set()
    for i, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - 99):
            if b[k : k + 100] in seen:
                want.add((i, k))
            seen.add(b[k : k + 100])
    assert got == want


def _sorted_pieces(parts, texts):
    rows = sorted((r for b in parts for r in b.to_pylist()), key=lambda r: (r["g"], r["id"], r["p"] + r["off"]))
    for r in rows:
        r["bytes"] = texts[r["id"]].encode()[r["p"] : r["p"] + r["n"] + 99]
    kinds = {"id": pa.int64(), "tie": pa.int64(), "p": pa.int32(), "n": pa.int16(), "off": pa.int16(), "g": pa.int64(), "bytes": pa.binary()}
    return pa.RecordBatch.from_pylist(rows, pa.schema(kinds))


def _windows(batch):
    return [{"id": r["id"], "p": r["p"] + k} for r in batch.to_pylist() for k in range(r["n"])]


def test_removal_over_a_whole_table(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    got = suffix_dedup.without_repeats(docs).collect()
    assert sorted(map(tuple, got)) == sorted(removed([tuple(r) for r in docs.collect()]))


def test_removal_from_awkward_rows(spark):
    odd = awkward(spark).where("doc_id is null or doc_id <> 3")
    want = {d: r for d, *r in removed([(r.doc_id, r.text) for r in odd.dropDuplicates(["doc_id"]).collect()])}
    got = suffix_dedup.without_repeats(odd).collect()
    assert len(got) == odd.count() and all(list(r)[1:] == want[r.doc_id] for r in got)
    assert suffix_dedup.without_repeats(empty(spark)).count() == 0


@pytest.mark.parametrize("kind", ["long", "string"])
def test_removal_with_repeated_and_null_ids(spark, kind):
    """Rows of one id and different texts are different documents, in some order; equal rows are one; ids may be strings."""
    word = lambda x: x if x is None or kind == "long" else f"id{x}"
    rows = [(1, "b" * 300), (1, "c" * 200), (2, "c" * 150), (2, "b" * 120), (2, "b" * 120), (None, "d" * 130), (None, "e" * 130), (3, "d" * 110 + "e" * 110)]
    frame = spark.createDataFrame([(word(d), t) for d, t in rows], f"doc_id {kind}, text string")
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed) for r in suffix_dedup.without_repeats(frame).collect())
    want = [(1, 300, 299), (1, 200, 199), (2, 150, 150), (2, 120, 120), (2, 120, 120), (None, 130, 129), (None, 130, 129), (3, 220, 220)]
    assert got == sorted((str(word(d)), n, k) for d, n, k in want)


def test_factors():
    text = b"abcabcabxabcabcab" * 3
    want = [max((k for k in range(len(text) - i + 1) if text.find(text[i : i + k], 0, i + k - 1) >= 0 and text.find(text[i : i + k]) < i), default=0) for i in range(len(text))]
    order = np.array(sorted(range(len(text)), key=lambda i: text[i:]))
    common = [0] + [next((k for k in range(len(text)) if text[a + k : a + k + 1] != text[b + k : b + k + 1] or not text[a + k : a + k + 1]), 0) for a, b in zip(order, order[1:])]
    got = suffix_dedup.longest_previous_factors(order, np.array(common))
    assert got[np.argsort(order)].tolist() == want


# -- near-duplicates ---------------------------------------------------------------------------
def bag(text):
    w = (text or "").split()
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def similarity(a, b):
    both = sum((a & b).values())
    return both / max(1, sum((a | b).values())) if a and b else 0.0


def test_signatures_estimate_weighted_similarity():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(40)]
    errors = []
    for share in (0.2, 0.5, 0.8, 0.95):
        for _ in range(10):
            a = [rng.choice(words) for _ in range(300)]
            b = [w if rng.random() < share ** 0.2 else rng.choice(words) for w in a] + ["rep rep rep"] * rng.randint(0, 20)
            texts = [" ".join(a), " ".join(b)]
            h, t = near_dedup.bag_shingles([x.encode() for x in texts])
            s = near_dedup.bag_minhash(h, t, 2)
            errors.append((s[0] == s[1]).mean() - similarity(bag(texts[0]), bag(texts[1])))
            own = [near_dedup.bag_shingles([x.encode()])[0] for x in texts]
            assert near_dedup.overlap(*own) == pytest.approx(similarity(bag(texts[0]), bag(texts[1])))
    assert abs(np.mean(errors)) < 0.02 and np.max(np.abs(errors)) < 0.2


def brute_classes(rows):
    bags = {d: bag(t) for d, t in rows}
    root = {d: d for d in bags}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(bags)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if bags[a] and bags[b] and similarity(bags[a], bags[b]) >= 0.8:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: find(d) for d in ids}


def family(rng, size, edit, n_words=80):
    base = [f"{rng.choice('abcdef')}{rng.randint(0, 400)}" for _ in range(n_words)]
    return [" ".join(w if rng.random() > edit else f"e{rng.randint(0, 9999)}" for w in base) for _ in range(size)]


def test_classes_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "CHUNK", 16)
    rng = random.Random(5)
    texts = [t for size, edit in ((2, 0.01), (3, 0.02), (60, 0.005), (40, 0.015), (5, 0.0), (8, 0.1), (1, 0), (1, 0)) for t in family(rng, size, edit)]
    texts += [None, "", "  ", "two words", "two words", "two  words", "other words"]
    rows = list(enumerate(texts))
    want = brute_classes(rows)
    got = {r.doc_id: r.class_id for r in near_dedup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got.keys() == want.keys()
    wrong = [d for d in want if got[d] != want[d]]
    assert len(wrong) <= 0.03 * len(want), wrong
    kept = near_dedup.first_of_class(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(d for d, c in got.items() if d == c)


def shingled(rng, n_words, edits):
    """A text of distinct words, and a copy with each position of edits replaced, per list of edits."""
    base = [f"w{rng.randint(0, 10**9)}" for _ in range(n_words)]
    return [" ".join(f"e{rng.randint(0, 10**9)}" if i in at else w for i, w in enumerate(base)) for at in edits]


def test_links_beside_a_sure_one(spark):
    """Edits of 0.88 to a base of larger id, and of 0.78 to each other: all of them belong to the base."""
    rng = random.Random(11)
    texts = [t for _ in range(40) for t in shingled(rng, 100, [*({k, k + 1} for k in range(5, 95, 12)), ()])]
    rows = list(enumerate(texts))
    got = {r.doc_id: r.class_id for r in near_dedup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {d: d - d % 9 for d, _ in rows}


@pytest.mark.parametrize("block", [16, 1024])
def test_pairs_in_a_bucket_of_unlike_members(spark, monkeypatch, block):
    """Texts of one template at 0.74 to each other, each with a partner at 0.84 that usually is in another chunk or block."""
    monkeypatch.setattr(near_dedup, "CHUNK", 16)
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    rng = random.Random(12)
    first = [set(rng.sample(range(0, 400, 6), 6)) for _ in range(90)]
    template = [f"w{i}" for i in range(400)]
    make = lambda at, name: " ".join(f"{name}x{i}" if i in at else w for i, w in enumerate(template))
    texts = [make(at, f"a{k}") for k, at in enumerate(first)]
    for k, text in enumerate(texts[:]):
        own = rng.sample(sorted(set(range(0, 400, 6)) - first[k]), 7)
        texts.append(" ".join(f"b{k}x{i}" if i in own else w for i, w in enumerate(text.split())))
    rows = list(enumerate(texts))
    want = brute_classes(rows)
    assert sum(want[k] == want[90 + k] for k in range(90)) == 90 and len(set(want.values())) > 80
    got = {r.doc_id: r.class_id for r in near_dedup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


def test_listed_components_bring_pairs_together():
    """Signatures that agree in MAYBE of their components meet at exactly one listed component; those that only share a passage nowhere."""
    rng = np.random.default_rng(4)
    shared = rng.integers(0, 1 << 16, near_dedup.M)
    alike = [int(k) for k in rng.integers(40, near_dedup.M + 1, 400)]
    sigs = np.array([np.where(rng.permutation(near_dedup.M) < k, shared, rng.integers(0, 1 << 16, near_dedup.M)) for k in alike], np.uint16)
    values = near_dedup.component_values([x.tobytes() for x in sigs])
    common, counts = np.unique(values, return_counts=True)
    often = counts > 2
    listed, seen = near_dedup.rarest(values, common[often], counts[often])
    at = [dict(zip(v.tolist(), np.unpackbits(m, axis=1).astype(bool))) for v, m in zip(listed, seen)]
    close = 0
    for i in range(len(sigs)):
        for j in range(i):
            agree = sigs[i] == sigs[j]
            owners = [v for v in at[i].keys() & at[j].keys() if not (agree & at[i][v]).any()]
            assert owners == [v for v in at[i].keys() & at[j].keys() if not (agree & at[j][v]).any()] and len(owners) <= 1
            if agree.mean() >= near_dedup.MAYBE:
                close += 1
                assert len(owners) == 1
    assert close > 1000
    shared_by_all = np.where(np.arange(near_dedup.M) < 60, shared, rng.integers(0, 1 << 16, (3000, near_dedup.M))).astype(np.uint16)
    values = near_dedup.component_values([x.tobytes() for x in shared_by_all])
    listed, _ = near_dedup.rarest(values, values[0, :60], np.full(60, 3000))
    assert np.unique(listed, return_counts=True)[1].max() < 8


@pytest.mark.parametrize("large", [1, 1000])
def test_large_buckets_are_searched_whole(spark, monkeypatch, large):
    """Texts that share most of their words, at 0.6 to each other, with a few partners among them: same classes with and without refinement."""
    refined, ran = near_dedup._refined, []
    monkeypatch.setattr(near_dedup, "_refined", lambda *a: ran.append(1) or refined(*a))
    for name, value in (("CHUNK", 16), ("BLOCK", 16), ("TALLY", 64), ("LARGE", large)):
        monkeypatch.setattr(near_dedup, name, value)
    rng = random.Random(14)
    passage = " ".join(f"p{i}" for i in range(220))
    texts = [passage + " " + " ".join(f"t{k}w{i}" for i in range(70)) for k in range(200)]
    for k in range(0, 200, 10):  # the partner of a text differs in four words of its own part
        gone = rng.sample(range(226, 286, 6), 4)
        texts.append(" ".join(f"x{i}" if i in gone else w for i, w in enumerate(texts[k].split())))
    rows = list(enumerate(texts))
    got = {r.doc_id: r.class_id for r in near_dedup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_classes(rows) and bool(ran) == (large == 1)


def test_classes_of_a_whole_table(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    want = brute_classes([tuple(r) for r in docs.collect()])
    assert {r.doc_id: r.class_id for r in near_dedup.classes(docs).collect()} == want


def test_classes_of_awkward_rows(spark):
    odd = awkward(spark)
    got = near_dedup.classes(odd).collect()
    assert len(got) == odd.count()
    assert {r.class_id for r in got if r.doc_id in (4, 5)} == {4}
    kept = near_dedup.first_of_class(odd)
    assert kept.columns == odd.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter([None, 0, 1, 2, 3, 4, 6, 7, 8, 9])
    assert near_dedup.classes(empty(spark)).count() == 0 and near_dedup.first_of_class(empty(spark)).count() == 0


def test_classes_with_repeated_and_null_ids(spark):
    """Rows without an id and unlike texts under one id are classed by their words; equal rows stay once."""
    rng = random.Random(8)
    x, y, z = (shingled(rng, 100, [(), (50,)]) for _ in range(3))
    rows = [(None, x[0]), (7, x[1]), (None, y[0]), (None, y[0]), (3, z[0]), (3, y[1]), (3, x[0]), (9, z[1]), (9, z[1]), (None, ""), (None, None), (None, "other words here")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r.doc_id, r.class_id) for r in near_dedup.classes(frame).collect())
    assert got == Counter([(None, 3), (7, 3), (None, 3), (None, 3), (3, 3), (3, 3), (3, 3), (9, 3), (9, 3), (None, None), (None, None), (None, None)])
    kept = Counter((r.doc_id, r.text) for r in near_dedup.first_of_class(frame).collect())
    assert kept == Counter([(3, z[0]), (3, y[1]), (3, x[0]), (None, ""), (None, None), (None, "other words here")])
    words = near_dedup.classes(frame.select(F.concat(F.lit("d"), F.col("doc_id")).alias("doc_id"), "text")).collect()
    assert {r.class_id for r in words} == {"d3", None}


def test_families_of_edits(spark):
    """Families of edited texts in which many pairs are just below the limit: no link is lost but by banding."""
    rng = random.Random(1)
    texts = [t for size in [60] * 6 + [400] for t in shingled(rng, 200, [set(rng.sample(range(200), rng.randint(0, 6))) for _ in range(size)])]
    rows = list(enumerate(texts))
    bags = [set(bag(t)) for t in texts]
    links, root = [], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(bags[i] & bags[j])
            if both and both >= 0.8 * (len(bags[i]) + len(bags[j]) - both):
                links.append((i, j))
                root[max(find(i), find(j))] = min(find(i), find(j))
    got = {r.doc_id: r.class_id for r in near_dedup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(links) > 10_000 and sum(got[i] == got[j] for i, j in links) >= 0.995 * len(links)
    true = Counter(find(i) for i in range(len(rows)))
    kept = Counter((find(i), got[i]) for i in range(len(rows)))
    pairs = lambda n: sum(k * (k - 1) // 2 for k in n.values())
    assert pairs(kept) >= 0.99 * pairs(true) and len(set(got.values())) >= len(true)


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in near_dedup.components(links, near_dedup.Scratch(spark, "chain")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 101: 100}


def test_word_hashes_do_not_depend_on_pieces(monkeypatch):
    from ledgerlens.llm import kernels

    data = (b"some words " * 500) + b"w" * 3000 + b" tail " * 40
    want = word_hashes(data, PLAIN)
    monkeypatch.setattr(kernels, "PIECE", 64)
    got = word_hashes(data, PLAIN)
    assert (got == want).all() and len(want) == 1041


def test_word_hashes_tell_all_words_apart():
    """Complementary words that polynomials modulo 2**64 take for equal, and words about as long as a piece."""
    for n in (10, 12, 13):
        word = b"a"
        for _ in range(n):
            word += word.translate(bytes.maketrans(b"ab", b"ba"))
        other = word.translate(bytes.maketrans(b"ab", b"ba"))
        assert len(set(word_hashes(word + b" " + other, PLAIN).tolist())) == 2
    seen = set()
    for size in range((1 << 20) - 2, (1 << 20) + 3):
        alone = word_hashes(b"w" * size, PLAIN).tolist()
        assert len(alone) == 1 and all(word_hashes(a + b"w" * size + z, PLAIN).tolist()[i] == alone[0] for a, z, i in ((b" ", b" ", 0), (b"", b" x", 0), (b"x ", b"", 1), (b"x  ", b" y", 1)))
        seen |= set(alone)
    assert len(seen) == 5
    words = [bytes([97 + i % 26]) * k for i in range(26) for k in range(1, 80)]
    assert len(set(word_hashes(b" ".join(words), PLAIN).tolist())) == len(words)
