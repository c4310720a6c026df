"""Spelling variants, collocations and packing against plain Python."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ledgerlens.llm import collocations, packing, queries, variants
from tests.llm.cases import awkward, empty

DATA = "/root/testdata/sf0.001"
LOWER = {i: i + 32 for i in range(65, 91)}


@pytest.fixture(scope="module")
def docs(spark):
    return [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang").collect()]


# -- spelling variants -------------------------------------------------------------------------
def plain_words(docs, spoil):
    out = Counter()
    for d, text, *_ in docs:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = w.translate(LOWER)
            h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
            if spoil and h % spoil == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= 7:
                out[w] += 1
    return {w: n for w, n in out.items() if n >= 2}


def edits(w):
    """Everything that w and a word one edit away have in common: itself, and itself without a code point, by place."""
    return {(i, w[:i] + w[i + 1 :]) for i in range(len(w))}


def plain_variants(n):
    by = defaultdict(set)
    for w in n:
        for k in edits(w):
            by[k].add(w)
    near = defaultdict(set)
    for w in n:
        for _, v in edits(w):
            if v in n:
                near[w].add(v)
                near[v].add(w)
    for same in by.values():
        for w in same:
            near[w] |= same - {w}
    form = {}
    for w, own in near.items():
        best = min(own, key=lambda v: (-n[v], v), default=None)
        if best and n[best] >= 10 * n[w]:
            form[w] = best
    out = set()
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None))
    return out


def test_variants_of_documents(spark, docs):
    got = {tuple(r) for r in queries.op11_spelling_variants(spark, DATA).collect()}
    assert got == plain_variants(plain_words(docs, 31)) and any(r[1] for r in got) and max(r[4] for r in got) > 2


def test_variants_of_few_letters_and_chains(spark):
    """Words of repeated letters, whose bigrams tie, and chains of forms."""
    rng = np.random.default_rng(1)
    n = {"".join(rng.choice(list("abé"), rng.integers(7, 10))): int(10 ** rng.uniform(0.31, 5)) for _ in range(700)}
    n |= {"aaaaaaa": 2, "aaaaaaaa": 30, "aaaaaaaaa": 400, "aaaaaaaaaa": 5000, "aaaaaaaaaaa": 60_000, "aaaaaaaaaaaa": 10**9}
    got = {tuple(r) for r in variants.variants(spark.createDataFrame(list(n.items()), "word string, n long")).collect()}
    assert got == plain_variants(n)
    assert variants.variants(spark.createDataFrame([], "word string, n long")).count() == 0


def test_dictionary_of_awkward_rows(spark, monkeypatch):
    monkeypatch.setattr(variants, "COUNTED", 3)
    odd = awkward(spark)
    for spoil in (None, 3):
        got = {r.word: r.n for r in variants.dictionary(odd, spoil=spoil).collect()}
        assert got == plain_words([(r.doc_id, r.text) for r in odd.collect()], spoil) and got
    assert variants.dictionary(empty(spark)).count() == 0


# -- collocations ------------------------------------------------------------------------------
def plain_collocations(docs, least=100, longest=5, covered=100, top=2000):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang in docs:
        lang = lang or "und"
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, own in f.items():
        found = {p: a for p, a in own.items() if len(p) > 1 and a >= least}
        over = Counter()
        for p, a in found.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    over[p[i : i + k]] = max(over[p[i : i + k]], a)
        scored = []
        for p, a in found.items():
            if 100 * over[p] < covered * a:
                score, k = min((1000 * a * n[lang] // (own[p[:k]] * own[p[k:]]), k) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), own[p[:k]], own[p[k:]]))
        for rank, (score, a, p, l, r) in enumerate(sorted(scored)[:top], 1):  # noqa: E741
            out.append((lang, rank, p.decode(), -a, l, r, n[lang], -score))
    return sorted(out)


def ordered(df):
    return sorted(map(tuple, df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()))


@pytest.mark.parametrize("head, dealt, mined", [(400_000, (20_000, 2_000_000), 200_000), (7, (30, 30), 500)])
def test_collocations(spark, docs, monkeypatch, head, dealt, mined):
    """All words in the head and no hot pivot; and most words beyond the head, pivots dealt to many tasks, and fragments mined in small parts."""
    monkeypatch.setattr(collocations, "DEALT", dealt)
    monkeypatch.setattr(collocations, "MINED", mined)
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(3)
    for settings in ({"least": 4, "top": 150}, {"least": 3, "longest": 3, "covered": 80}):
        want = plain_collocations(docs, **settings)
        assert ordered(collocations.collocations(frame, head=head, **settings)) == want and len(want) > 100


def test_collocations_of_awkward_rows(spark):
    odd = awkward(spark)
    rows = [(r.doc_id, r.text, r.lang) for r in odd.collect()] + [(1, "a a a a a a a, A\ta. b a", None)] * 40
    more = odd.select("doc_id", "text", "lang").unionByName(spark.createDataFrame(rows[-40:], "doc_id long, text string, lang string"))
    want = plain_collocations(rows)
    assert ordered(collocations.collocations(more)) == want and len(want) > 3
    assert collocations.collocations(empty(spark)).count() == 0
    big = spark.createDataFrame([(10**13, 10**14, 3 * 10**13, 10**13)], "a long, n long, l long, r long")
    exact = big.select((F.lit(1000).cast("decimal(4,0)") * collocations._wide("a") * collocations._wide("n")).alias("top"), (collocations._wide("l") * collocations._wide("r")).alias("bottom"))
    assert exact.select(F.expr("top div bottom")).first()[0] == 1000 * 10**13 * 10**14 // (3 * 10**26)


def test_repeated_rows_are_added_up():
    found, n = collocations.distinct_rows(np.array([[1, 2], [1, 2], [3, 4], [1, 2], [5, 6]]), np.array([1, 2, 3, 4, 5]))
    assert {tuple(r): k for r, k in zip(found.tolist(), n.tolist())} == {(1, 2): 7, (3, 4): 3, (5, 6): 5}


# -- packing -----------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def tokenizer():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


def check_packing(rows, texts, tokenizer, capacity=2048):
    """rows: of pack(); texts: those of the documents, in any order. Every piece is right, sequences have no gaps, and they are few."""
    want = Counter()
    for d, text in texts:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        cut = [0, *range(len(ids) % capacity or capacity, len(ids), capacity), len(ids)]
        for k, (a, z) in enumerate(zip(cut, cut[1:])):
            want[d, k, a, z - a, zlib.crc32(np.array(ids[a:z], "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    own = defaultdict(list)
    for r in rows:
        own[r.sequence_id].append((r.offset, r.length))
    for parts in own.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(own), -(-sum(r.length for r in rows) // capacity)


def test_packing_of_documents(spark, docs, tokenizer):
    n, least = check_packing(queries.op13_packing(spark, DATA).collect(), [d[:2] for d in docs], tokenizer)
    assert n <= 1.01 * least + 1


def test_packing_of_awkward_rows(spark, tokenizer):
    odd = awkward(spark)
    for capacity in (2048, 64):
        got = packing.pack(odd, capacity=capacity, with_ids=True)
        n, least = check_packing(got.collect(), [(r.doc_id, r.text) for r in odd.collect()], tokenizer, capacity)
        assert n <= least + 4
    whole = {r.sequence_id: r.ids for r in packing.sequences(got).collect()}
    for r in got.collect():
        assert whole[r.sequence_id][r.offset : r.offset + r.length] == r.ids
    assert packing.pack(empty(spark)).count() == 0


def test_plans_hold_every_piece_once():
    rng = np.random.default_rng(0)
    for k in range(300):
        capacity = int(rng.choice([9, 10, 64, 2048]))
        counts = Counter(np.minimum(capacity, 1 + rng.exponential(capacity / rng.integers(1, 6), rng.integers(0, 300)).astype(int)).tolist())
        seen, own = set(), defaultdict(list)
        for n, first, count, each, at, offset in packing.plan(counts, capacity):
            for i in range(count):
                seen.add((n, first + i))
                own[at + i // each].append((offset + i % each * n, n))
        assert len(seen) == sum(counts.values()) and all((n, c - 1) in seen for n, c in counts.items())
        for parts in own.values():
            assert [o for o, _ in sorted(parts)] == np.cumsum([0, *[n for _, n in sorted(parts)]])[:-1].tolist() and sum(n for _, n in parts) <= capacity
        large = Counter({n: c for n, c in counts.items() if 3 * n > capacity})
        assert len({at for at, parts in own.items() if any(n in large for _, n in parts)}) == most_pairs(large, capacity)
    huge = packing.plan({n: 10**9 // n for n in range(1, 2049)})
    assert len(huge) < 20_000 and max(r[4] + (r[2] - 1) // r[3] for r in huge) < 1.001 * 10**9


def most_pairs(large, capacity):
    """The least bins of items over a third: two pointers over all of them."""
    items, n, i = sorted(large.elements()), 0, 0
    j = len(items) - 1
    while i <= j:
        if i < j and items[i] + items[j] <= capacity:
            i += 1
        j -= 1
        n += 1
    return n


def test_encoder_is_the_tokenizer(tokenizer):
    rng, own = np.random.default_rng(3), packing.public_encoder()
    letters = [" "] * 8 + list("abcdEF'.,!?0123\n\t\r\x0b\x1c\x1f\x85\xa0 　é×ßñ日本語​᠎\U0001f600Ж's½") + [chr(c) for c in range(0x21, 0x250)]
    texts = ["".join(rng.choice(letters, rng.integers(0, 60))) for _ in range(3000)] + ["plain words again and again, it's  two spaces", "<|endoftext|>", "", " ", "x " * 50]
    for at in range(0, len(texts), 500):
        for text, ids in zip(texts[at:], own(texts[at : at + 500])):
            assert np.frombuffer(ids, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids
