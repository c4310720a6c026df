"""Operators whose results per document are compared with plain Python over whole tables."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import decontamination, language_id, mixing, ordinal, pii, quality_rules, queries, sharding, warc
from ledgerlens.llm.common import Scratch
from tests.llm.cases import awkward, empty, labels

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang", "source").collect()]


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


# -- decontamination ---------------------------------------------------------------------------
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").translate({i: i + 32 for i in range(65, 91)}))


def hits(texts, items, window=10):
    wins = defaultdict(set)
    for k, t in items:
        w = words(t)
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            wins[tuple(w[i : i + n])].add(k)
    out = []
    for d, t in texts:
        w, hit, found = words(t), set(), set()
        for n in {len(x) for x in wins}:
            for i in range(len(w) - n + 1):
                if own := wins.get(tuple(w[i : i + n])):
                    hit |= set(range(i, i + n))
                    found |= own
        found = {str(k) for k in found if k is not None}
        out.append((d, len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)))
    return out


def near(texts, queries, slop, rarest):
    count = Counter(x for _, t in texts for x in words(t))
    out = {}
    for name, q in queries:
        terms = sorted((x for x in dict.fromkeys(words(q)) if count[x]), key=lambda x: count[x])[:rarest]
        for d, t in texts if terms else []:
            w = words(t)
            n = sum(w[i] == terms[0] and set(terms) <= set(w[max(0, i - slop) : i + slop + 1]) for i in range(len(w)))
            if n:
                out[d, str(name)] = n
    return out


def test_contamination_matches_brute_force(spark, docs, monkeypatch):
    """In one block of windows and in many, over shards of a few documents too."""
    items = [tuple(r) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").select("item_id", "text").collect()]
    want = sorted(hits([(d, t) for d, t, _, _ in docs], items))
    assert sorted(map(tuple, queries.op3_decontamination(spark, DATA).collect())) == want
    monkeypatch.setattr(decontamination, "BLOCK_TERMS", 5000)
    monkeypatch.setattr(decontamination, "CANDIDATES", 50)
    table = lambda n: spark.read.parquet(f"{DATA}/{n}.parquet")
    assert sorted(map(tuple, decontamination.contamination(table("documents"), table("benchmark")).drop("items").collect())) == want
    kept = decontamination.clean(table("documents"), table("benchmark"))
    assert kept.columns == table("documents").columns and sorted(r.doc_id for r in kept.collect()) == [x[0] for x in want if not x[-1]]


def test_contamination_of_awkward_rows(spark):
    rows = awkward(spark).unionByName(awkward(spark).where("doc_id = 5").withColumn("text", F.lit("another text, no id at all")))
    items = [(1, "Same WORDS, here again"), (2, "日本語"), (3, None), (4, "!!"), (None, "x"), (None, "another text"), (5, "Lorem ipsum dolor sit amet consectetur lorem ipsum dolor sit amet"), (6, "日本語"), (6, "again")]
    marks = spark.createDataFrame(items, "item_id long, text string")
    own = [(r.doc_id, r.text) for r in rows.collect()]
    want = sorted(map(str, hits(own, items)))
    assert sorted(map(str, map(tuple, decontamination.contamination(rows, marks).drop("items").collect()))) == want
    assert any("(6, 1, 1, 0," in x for x in want)  # hit by the item without an id
    kept = decontamination.clean(rows, marks)
    assert kept.columns == rows.columns and sorted(str((r.doc_id, r.text)) for r in kept.collect()) == sorted(str(o) for o, x in zip(own, hits(own, items)) if not x[-1])
    assert decontamination.contamination(empty(spark), marks).count() == 0 and decontamination.clean(empty(spark), marks).count() == 0
    assert not any(r.contaminated for r in decontamination.contamination(rows, empty(spark, "item_id long, text string")).collect())


def test_proximity(spark, docs, monkeypatch):
    rows = spark.createDataFrame([(1, "red apple pie"), (2, "red red and a green apple"), (3, "apple. " * 3), (4, None)], "doc_id long, text string")
    asked = spark.createDataFrame([("near", "apple red"), ("none", ""), ("lost", "apple tree")], "name string, text string")
    got = {(r.doc_id, r["query"]): r.matches for r in decontamination.proximity(rows, asked, 2).collect()}
    assert got == {(1, "near"): 1}
    items = [tuple(r) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").select("item_id", "text").collect()]
    want = near([(d, t) for d, t, _, _ in docs], items, 12, 3)
    assert want and {(r.doc_id, r["query"]): r.matches for r in queries.decontamination_proximity(spark, DATA).collect()} == want
    monkeypatch.setattr(decontamination, "BLOCK_TERMS", 300)
    assert {(r.doc_id, r["query"]): r.matches for r in queries.decontamination_proximity(spark, DATA).collect()} == want


# -- personal data -----------------------------------------------------------------------------
PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(s):
    d = [int(c) for c in reversed(s)]
    return sum(x if i % 2 == 0 else (x * 2 - 9 if x > 4 else x * 2) for i, x in enumerate(d)) % 10 == 0


def base_spans(text):
    out = []
    for rank, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text or ""):
            n = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 12 <= len(n) <= 19 and luhn(n), "phone": 9 <= len(n) <= 15}[kind]:
                out.append((m.start(), rank, kind, m.end()))
    return sorted(out)


def as_pii(d, text):
    spans = base_spans(text)
    n = Counter(k for _, _, k, _ in spans)
    return (d, *(n[k] for k in PLAIN), sha(",".join(f"{k}:{s}:{e}" for s, _, k, e in spans)))


TRICKY = [
    "a@b.c_d@e.f x.y@z.q. é 4111 1111 1111 1111 and 4111111111111112", "999.1.1.1 1.2.3.4.5.6.7.8 10.0.0.1", "+1 (555) 010-9999 +12 +1-2-3", "00000000000000000000000001.1.1.1", "me@" * 50 + "x.y",
    "IBAN GB82 WEST 1234 5698 7654 32 and GB82 WEST 1234 5698 7654 33", "ssn 123-45-6789 card 5500-0000-0000-0004", "a.b.c@d.e.f.g.h-@i..j", "日本 bob@example.com \x01 4012888888881881", "@." * 2000, "1" * 5000, "a" * 50000 + "@b.c",
]


def test_pii_matches_plain_patterns(spark, docs):
    got = sorted((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in queries.op5_pii(spark, DATA).collect())
    assert got == sorted(as_pii(d, t) for d, t, _, _ in docs)
    rows = spark.createDataFrame(list(enumerate(TRICKY)), "doc_id long, text string").unionByName(awkward(spark).select("doc_id", "text"))
    got = [(r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in pii.digest(pii.pii_spans(rows)).collect()]
    assert sorted(map(str, got)) == sorted(str(as_pii(r.doc_id, r.text)) for r in rows.collect())
    assert pii.pii_spans(empty(spark)).count() == 0


def test_pii_of_many_matches_takes_time_in_proportion(spark):
    took = []
    for n in (4_000, 40_000):
        row = spark.createDataFrame([(1, " ".join(f"user{i}@example.com" for i in range(n)))], "doc_id long, text string")
        began = time.perf_counter()
        assert pii.digest(pii.pii_spans(row)).first().n_email == n
        took.append(time.perf_counter() - began)
    assert took[1] < 20 * took[0] + 5


def test_pii_checks_and_context(spark):
    rows = pii.pii_spans(spark.createDataFrame(list(enumerate(TRICKY)), "doc_id long, text string"))
    got = {r.doc_id: [(s.kind, s.match) for s in r.spans] for r in rows.collect()}
    assert [m for k, m in got[5] if k == "iban"] == ["GB82 WEST 1234 5698 7654 32"]
    assert ("ssn", "123-45-6789") in got[6]
    assert ("ssn", "123-45-6789") not in {(k.kind, k.match) for r in pii.pii_spans(spark.createDataFrame([(1, "ssn of order 123-45-6789")], "doc_id long, text string")).collect() for k in r.spans}
    assert [r.spans[0].kind for r in pii.pii_spans(spark.createDataFrame([(1, "123-45-6789 is my social number")], "doc_id long, text string")).collect()] == ["ssn"]
    masked = spark.createDataFrame([("mail bob@x.org now",)], "text string").withColumn("doc_id", F.lit(1))
    spans = pii.pii_spans(masked).collect()[0].spans
    assert spans[0].score == 1.0
    joined = masked.join(pii.pii_spans(masked), "doc_id").select(pii.masked(F.col("text"), F.col("spans")))
    assert joined.collect()[0][0] == "mail [email] now"


# -- quality rules -----------------------------------------------------------------------------
def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def base_stats(text):
    w = split(text)
    tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = Counter(tri)
    repeat = len({i + j for i, x in enumerate(tri) if n[x] > 1 for j in range(3)})
    lines = [x for x in (text or "").split("\n") if split(x)]
    failed = len(w) < 50 or 100 * repeat > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), repeat, failed


def test_quality_statistics_match_brute_force(spark, docs):
    rows = queries.op8_quality_rules(spark, DATA).collect()
    assert sorted(tuple(r)[:-1] for r in rows) == sorted((d, *base_stats(t)) for d, t, _, _ in docs)
    assert all(not r.kept for r in rows if r.base_failed)
    odd = awkward(spark)
    got = quality_rules.with_stats(odd.select("doc_id", "text")).select("doc_id", *[f"__q.{c}" for c in quality_rules.BASE_FIELDS], quality_rules.base_failed())
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(str((r.doc_id, *base_stats(r.text))) for r in odd.collect())


def test_cutoffs_are_certified(spark):
    from math import comb

    n, p = 700, 0.01
    for k in (0, 2, 5):
        got = spark.range(1).select(quality_rules.binomial_tail(F.lit(k).cast("long"), F.lit(n).cast("long"), p)).collect()[0][0]
        assert got == pytest.approx(sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)), rel=1e-9)
    rows = [(i, " ".join(f"#{i}x{j} $LOUD!{j}" if i % 4 == 3 else f"calm{i} w{j}" for j in range(60)), "en") for i in range(6000)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    marks = labels(spark, [(i, int(i % 4 != 3), 0) for i in range(6000)])
    done = quality_rules.rated(table, marks, ["doc_id", "lang"])
    assert {r.doc_id for r in done.where("__kept").collect()} == {i for i in range(6000) if i % 4 != 3}
    few = quality_rules.rated(table.where("doc_id < 200"), marks, ["doc_id", "lang"])
    assert few.where("__kept").count() == sum(1 for i in range(200))  # too few labels to certify anything
    odd = awkward(spark)
    assert quality_rules.rated(odd, labels(spark), odd.columns).count() == odd.count()
    assert quality_rules.rated(empty(spark), marks, ["doc_id", "lang"]).count() == 0


def test_cutoffs_match_brute_force(spark):
    """Over strata with noisy labels, some with too few: the same cutoffs as by plain Python."""
    rng = random.Random(4)
    rules, rows = list(quality_rules.RULES), []
    for i in range(9000):
        good = rng.random() < 0.7
        n = rng.randint(60, 200)
        part = lambda top: int(n * max(0.0, rng.gauss(0.01 if good else top, 0.01)))
        q = {"n_words": n, "n_lines": n, "word_chars": n, "n_symbols": part(0.2), "n_exclaims": part(0.02), "n_upper": part(0.3), "n_dup_lines": part(0.0), "n_repeat_words": part(0.25)}
        rows.append((i, rng.choice(["en", "en", "de", None]) if i > 60 else "few", q, int(good)))
    schema = "doc_id long, lang string, __q struct<" + ",".join(f"{k}:long" for k in rows[0][2]) + ">"
    stats = spark.createDataFrame([(i, x, tuple(q.values())) for i, x, q, _ in rows], schema)
    marks = labels(spark, [(i, g, 0) for i, _, _, g in rows])
    got = {r[0]: {k: r[f"__max_{k}"] for k in rules} for r in quality_rules.certified_cutoffs(stats, marks).collect()}
    first = {r.doc_id for r in stats.where("pmod(xxhash64('holdout', doc_id), 2) = 0").collect()}
    ratio = lambda q, r: q[quality_rules.RULES[r][0]] / max(1, q[quality_rules.RULES[r][1]])
    fine = [x for x in rows if 100 * x[2]["n_repeat_words"] <= 50 * x[2]["n_words"]]
    strata = {x for i, x, _, g in fine if g and i in first}
    want = {}
    for s in strata:
        own = [x for x in fine if x[1] == s]
        good = [x[2] for x in own if x[3] and x[0] in first]
        best = None
        for b in quality_rules.BUDGETS:
            cut = {r: next((c for c in quality_rules.GRID if sum(ratio(q, r) > c for q in good) * len(rules) <= b * len(good)), None) for r in rules}
            lost = lambda q: any(cut[r] is not None and ratio(q, r) > cut[r] for r in rules)  # noqa: B023, E731
            test = [x[2] for x in own if x[3] and x[0] not in first]
            k, n = sum(map(lost, test)), len(test)
            p = sum(math.comb(n, i) * 0.01**i * 0.99 ** (n - i) for i in range(k + 1)) if k <= n * 0.01 else 1.0
            caught = sum(lost(x[2]) for x in own if not x[3] and x[0] in first)
            if p <= 0.05 / len(strata) / len(quality_rules.BUDGETS) and caught and (best is None or caught > best[0]):
                best = caught, cut
        if best:
            want[s] = best[1]
    assert got == want and {"en", "de"} <= set(got) and "few" not in got


# -- mixing ------------------------------------------------------------------------------------
def mix_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    left, open_, out = 1.5 * sum(sizes.values()), set(names), {}
    while open_:
        rate = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if rate * weight[s] > 2 * sizes[s]}
        if not full:
            return out | {s: rate * weight[s] for s in open_}
        for s in full:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
        open_ -= full
    return out


def check_mix(rows, docs):
    want = Counter()
    for _, text, source in docs:
        want[source] += len(split(text))
    target, taken = mix_targets(want), Counter()
    source = {}
    for d, _, s in docs:
        source[d] = s
    longest = max((r["size"] for r in rows), default=0)
    for r in rows:
        s = source[r.doc_id]
        assert r.source_size == want[s] and r.target == pytest.approx(target[s], rel=1e-9)
        assert r.taken in (0, r["size"], 2 * r["size"])
        taken[s] += r.taken
    for s in want:
        assert abs(taken[s] - target[s]) <= 2 * longest + 1
    assert sum(taken.values()) <= sum(target.values()) + 1


def test_mix(spark, docs):
    rows = queries.op10_mixing(spark, DATA).collect()
    assert len(rows) == len(docs)
    check_mix(rows, [(d, t, s) for d, t, _, s in docs])
    assert sorted(map(tuple, rows)) == sorted(map(tuple, queries.op10_mixing(spark, DATA).collect()))


def test_mix_of_awkward_rows(spark):
    odd = awkward(spark)
    got = mixing.with_taken(odd, mixing.cuts(spark, odd))
    assert got.count() == odd.count() and set(odd.columns) <= set(got.columns)
    none = empty(spark)
    assert mixing.with_taken(none, mixing.cuts(spark, none)).count() == 0
    many = spark.createDataFrame([(i, "a b c d " * (1 + i % 7), f"s{i % 5}" if i % 3 else "hot") for i in range(5000)], "doc_id long, text string, source string")
    rows = mixing.with_taken(many, mixing.cuts(spark, many)).select("doc_id", F.col("__size").alias("size"), "__cut.source_size", "__cut.target", (F.col("__size") * F.col("__times")).alias("taken")).collect()
    check_mix(rows, [tuple(r) for r in many.collect()])
    nameless = spark.createDataFrame([(None, f"w{i} " * (1 + i % 9), "a" if i % 3 else "b") for i in range(1200)], "doc_id long, text string, source string")
    taken = mixing.with_taken(nameless, mixing.cuts(spark, nameless)).groupBy("source").agg(F.sum(F.col("__size") * F.col("__times")).alias("taken"), F.first("__cut.target").alias("target"), F.countDistinct("__times").alias("kinds")).collect()
    assert all(abs(r.taken - r.target) <= 20 for r in taken) and max(r.kinds for r in taken) > 1


def plain_queue(rows):
    """Times that each (source, hash, id) of (source, hash, id, size) rows is taken by a fair queue of all finish times."""
    sizes = Counter()
    for s, _, _, n in rows:
        sizes[s] += n
    target = mix_targets(sizes)
    rank = {s: i for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, (s or "").encode())))}
    events, budget = [], sum(target.values())
    for s in sizes:
        done = 0
        for _, h, i, n in sorted(r for r in rows if r[0] == s and r[3]):
            done += n
            events.append((done / target[s], rank[s], h, i, 1, n, s))
            if target[s] > sizes[s]:
                events.append(((done + sizes[s]) / target[s], rank[s], h, i, 2, n, s))
    taken, total = Counter(), 0
    for _, _, h, i, _, n, s in sorted(events):
        total += n
        if total > budget:
            break
        taken[s, h, i] += 1
    return taken, target


def test_mix_is_a_plain_fair_queue(spark):
    equal = [(1, "ten words " * 5, "a")] * 900 + [(2 + i, f"w{i} " * (1 + i % 19), "b") for i in range(300)]
    others = [(i, f"w{i} " * (1 + i % 23), ["x", "y", None, "é"][i % 4 if i % 3 else 0]) for i in range(700)]
    for rows in (equal, others, others + equal):
        numbered = mixing.with_copies(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5))
        got = mixing.with_taken(numbered, mixing.cuts(spark, numbered)).select("source", mixing.order_hash("doc_id", 7).alias("h"), "doc_id", "__size", "__times", "__cut.target").collect()
        assert len(got) == len(rows)
        want, target = plain_queue([tuple(r)[:4] for r in got])
        assert {(r.source, r.h, r.doc_id): r["__times"] for r in got if r["__times"]} == dict(want)
        for s in target:  # within a document of the target, repeated rows as well
            assert abs(sum(r["__size"] * r["__times"] for r in got if r.source == s) - target[s]) <= 25


# -- sharding ----------------------------------------------------------------------------------
def test_shards_fit_and_only_oversized_buckets_split(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for limit in (5_000, 40_000, 10_000_000):
        rows = sharding.shard(docs, limit).collect()
        total, n = Counter(), Counter()
        for r in rows:
            total[r.shard] += r.n_bytes
            n[r.shard] += 1
            assert r.depth == len(r.shard) - 1
        for r in rows:
            assert r.shard_bytes == total[r.shard] and (total[r.shard] <= limit or n[r.shard] == 1)
            if len(r.shard) > 1:  # the bucket that was split was over the limit
                assert sum(v for k, v in total.items() if k.startswith(r.shard[:-1])) > limit
        names = set(total)
        assert not any(a != b and b.startswith(a) for a in names for b in names)
        assert {r.doc_id: r.n_bytes for r in rows} == {r.doc_id: len((r.text or "").encode()) for r in docs.collect()}


def test_shards_of_awkward_rows(spark):
    odd = awkward(spark)
    rows = sharding.shard(odd, 1000)
    assert set(odd.columns) <= set(rows.columns) and rows.count() == odd.count()
    total, n = Counter(), Counter()
    for r in rows.collect():
        total[r.shard] += r.n_bytes
        n[r.shard] += 1
    assert all(v <= 1000 or n[k] == 1 for k, v in total.items())
    assert sharding.shard(empty(spark), 10).count() == 0
    same = spark.createDataFrame([(1, "x" * 100, "kept", 5)] * 500 + [(2, "y" * 30, "kept", 5)] * 7, "doc_id long, text string, bytes string, before int").repartition(6)
    total, n = Counter(), Counter()
    for r in sharding.shard(same, 1000).collect():
        total[r.shard] += r.n_bytes
        n[r.shard] += 1
        assert (r.bytes, r.before) == ("kept", 5) and not r.oversize
    assert sum(n.values()) == 507 and max(total.values()) <= 1000 and sorted(total.values()).count(1000) == 50
    for r in sharding.shard(same, 1000).collect():
        assert r.shard_bytes == total[r.shard] and r.shard_docs == n[r.shard]


# -- archives ----------------------------------------------------------------------------------
def test_warc_round_trip(spark, tmp_path):
    html = [None, "", "é" * 400, "é" * 400, "x" * 99, "x" * 99, "y" * 100, "y" * 100, "z" * 5000, "é\r\n\r\nWARC/1.1\r\n" * 20, "y" * 100]
    rows = spark.createDataFrame([(i, "http://a/\r\nb" if i % 2 else None, h) for i, h in enumerate(html)] + [(None, None, "y" * 100), (2, None, "é" * 400)], "page_id long, url string, html string")
    chunks = warc.to_chunks(rows, Scratch(spark, "warc"), chunk=64).cache()
    assert max(r.n for r in chunks.where("chunk > 0").select(F.length("bytes").alias("n")).collect()) <= 64
    got = warc.records(chunks).collect()
    assert len(got) == rows.count() and all(r.intact for r in got)
    first = {}
    for i, h in enumerate(html):
        first.setdefault(h or "", i)
    for r in got:
        if r.page_id is None:
            assert (r.record_type, r.refers_to) == ("revisit", "6")
            continue
        i, h = int(r.page_id), html[int(r.page_id)] or ""
        assert r.payload_bytes == len(h.encode()) and r.payload_digest == sha(h)
        again = len(h.encode()) >= 100 and first[h] != i
        assert (r.record_type, r.refers_to) == (("revisit", str(first[h])) if again else ("response", None))
    warc.save_file(chunks, str(tmp_path / "a.warc"))
    assert (tmp_path / "a.warc").read_bytes().count(b"WARC-Record-ID: ") == rows.count()
    assert (tmp_path / "a.warc").read_bytes().count(b"WARC-Date: ") == rows.count()
    assert warc.round_trip(spark, empty(spark, "page_id long, url string, html string")).count() == 0


def test_warc_ids_and_columns(spark):
    """String ids of any characters, clashing columns, no url, a payload over a chunk, and repeated rows."""
    ids = ["a>\r\nX: 1", "<z>", "", None, "é %2B+", "a", "a"]
    html = ["p" * 200, "q" * 3_000_000, "p" * 200, "p" * 200, "", "q" * 3_000_000, "q" * 3_000_000]
    rows = spark.createDataFrame([(i, h, "x", 1) for i, h in zip(ids, html)], "page_id string, html string, digest string, record int")
    got = warc.round_trip(spark, rows).collect()
    assert all(r.intact for r in got)
    want = [("a>\r\nX: 1", 200, "revisit", ""), ("<z>", 3_000_000, "response", None), ("", 200, "response", None), (None, 200, "revisit", ""), ("é %2B+", 0, "response", None), *[("a", 3_000_000, "revisit", "<z>")] * 2]
    assert Counter((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in got) == Counter(want)


# -- classifiers -------------------------------------------------------------------------------
def test_language_of_held_out_rows(spark, docs):
    rows = queries.op6_language_id(spark, "/root/testdata/sf0.01").collect()
    lang = {r.doc_id: r.lang for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out and lang[r.doc_id]]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) / len(held) > 0.97
    odd = awkward(spark)
    model = language_id.train(odd)
    got = {(r.doc_id, r.lang_pred): r.score for r in language_id.predict(odd, model).collect()}
    assert got[0, "und"] == got[1, "und"] == got[2, "und"] == 0.0
    assert all(0 <= s <= 1 for s in got.values())
    none = language_id.train(empty(spark))
    assert {r.lang_pred for r in language_id.predict(odd, none).collect()} == {"und"}
    assert language_id.predict(empty(spark), model).count() == 0


def test_grades_of_held_out_labels(spark):
    table = lambda n: spark.read.parquet(f"/root/testdata/sf0.1/{n}.parquet")
    marks = table("labels")
    model = ordinal.train(table("documents"), marks.where("doc_id % 4 != 0"))
    assert (model.thresholds[1:] >= model.thresholds[:-1]).all()
    rows = ordinal.grade(table("documents"), model).join(marks.where("doc_id % 4 = 0"), "doc_id").collect()
    right = [r.kept == (r.quality == 1 and r.toxic == 0) for r in rows]
    assert sum(right) / len(right) > 0.93
    lost = [not r.kept for r in rows if r.quality == 1 and r.toxic == 0]
    assert sum(lost) / len(lost) < 0.02
    odd = awkward(spark)
    got = ordinal.grade(odd, ordinal.train(odd, labels(spark))).collect()
    assert len(got) == odd.count() and all(0 <= r.p_top <= r.p_middle <= 1 for r in got)
    assert ordinal.grade(empty(spark), model).count() == 0
    assert len(ordinal.grade(odd, ordinal.train(odd, labels(spark, [(4, None, None)]))).collect()) == odd.count()


def plain_grams(text):
    """Buckets of the pairs and triples of a padded, lower-cased text, by whole numbers."""
    t = f" {text.lower()}   "
    for k, n in enumerate(language_id.ORDERS):
        for at in range(len(t)):
            h = 0
            for i in range(n):
                if at + i < len(t):
                    h = ((h ^ ord(t[at + i])) * language_id.MULTIPLIERS[i]) % 2**32
                h ^= h >> 15
            yield (h >> (32 - language_id.BITS)) + (k << language_id.BITS)


def test_languages_match_plain_naive_bayes(spark, docs, monkeypatch):
    own = [(d, t, x) for d, t, x, _ in docs if t and len(t) < 3000][:80]
    counts, texts = defaultdict(Counter), Counter(x for _, _, x in own if x)
    for _, t, x in own:
        if x:
            counts[x].update(plain_grams(t))
    langs = sorted(texts)
    size, half = 1 << language_id.BITS, language_id.SMOOTH
    total = {x: [sum(n for b, n in counts[x].items() if b >> language_id.BITS == k) for k in range(2)] for x in langs}
    frame = spark.createDataFrame(own, "doc_id long, text string, lang string")
    (block,) = language_id.train(frame).blocks()
    assert block.languages == langs
    monkeypatch.setattr(language_id, "PIECE_CHARS", 50)
    for d, t, _ in own[:25]:
        grams = list(plain_grams(t))
        logs = [math.log(texts[x] / sum(texts.values())) + sum(math.log((counts[x][b] + half) / (total[x][b >> language_id.BITS] + half * size)) for b in grams) for x in langs]
        top = max(logs)
        want = langs[logs.index(top)], 1 / sum(math.exp(v - top) for v in logs)
        for texts_ in ([t.encode()], [t.encode(), b"other text"]):  # piece by piece, and with others
            scores = block.logs(texts_)[0]
            assert block.languages[scores[0].argmax()] == want[0] and 1 / np.exp(scores[0] - scores[0].max()).sum() == pytest.approx(want[1], abs=1e-3)
    many = spark.range(200).select(F.col("id").alias("doc_id"), F.lit("a text").alias("text"), F.col("id").cast("string").alias("lang"))
    learned = language_id.train(many)
    one, parts = (sorted(map(tuple, language_id.predict(many, learned, block=n).collect())) for n in (200, 37))
    assert [r[:2] for r in one] == [r[:2] for r in parts] and [r[2] for r in one] == pytest.approx([r[2] for r in parts]) and one[0][1:] == ("0", pytest.approx(1 / 200))


def test_sample_of_repeated_labels(spark, monkeypatch):
    """A label that is there many times is taken by the sample's rate, whatever its id."""
    seen = []
    monkeypatch.setattr(ordinal, "fit", lambda rows, grades: seen.append(len(rows)))
    docs_ = spark.createDataFrame([(i, f"text {i}") for i in (1, 2, 3)] + [(3, "another text")] * 50, "doc_id long, text string")
    for i in (1, 2):
        ordinal.train(docs_, labels(spark, [(i, 1, 0)] * 4000), train_rows=400)
    ordinal.train(docs_, labels(spark, [(3, 1, 0)] * 4000), train_rows=400)
    assert 399 <= seen[0] <= 401 and 399 <= seen[1] <= 401 and seen[2] <= 800


def test_grades_match_plain_likelihood(monkeypatch):
    """Features, likelihood and gradient by plain Python, and a fit that uses every feature."""
    rng = random.Random(6)
    texts = [" ".join(rng.choice(["good", "bad", "vile", "word", "é"]) + str(rng.randint(0, 3)) for _ in range(rng.randint(0, 30))) for _ in range(40)]
    t, f = ordinal.features([x.encode() for x in texts])
    rows = [f[t == i].astype("int32") for i in range(len(texts))]
    for x, r in zip(texts, rows):
        b = x.encode()
        pairs = {(((b[i] << 8 | b[i + 1]) * 0x9E3779B1 >> 7) & ((1 << ordinal.BITS - 1) - 1)) << 1 | 1 for i in range(len(b) - 1)}
        assert {v for v in r.tolist() if v & 1} == pairs
        assert len([v for v in r.tolist() if not v & 1]) == len(set(words(x)))
    grades = np.array([0 if "vile" in x else 1 if x.count("bad") > x.count("good") else 2 for x in texts])
    point = np.concatenate((np.random.default_rng(1).normal(0, 1, 1 << ordinal.BITS), [-1.0, 0.3]))
    monkeypatch.setattr(ordinal, "FIT_VALUES", 100)
    own = ordinal.Rows(rows, grades)
    scale = ordinal.strength(own)
    for i in rows[0][:5]:
        low, high = ([r for r, y in zip(rows, grades) if (y == 2) == top] for top in (False, True))
        share = lambda side: (sum(i in r for r in side) + 1) / (len(side) + 2)  # noqa: B023, E731
        assert scale[i] == pytest.approx(0.05 + abs(math.log(share(low) / share(high))))
    value, gradient = ordinal.loss(point, own, scale)
    cut = [-1.0, -1.0 + math.exp(0.3)]
    total = 0.0
    for r, y in zip(rows, grades):
        x = sum(point[v] * scale[v] for v in r) / math.sqrt(max(1, len(r)))
        tail = [1.0, *(1 / (1 + math.exp(c - x)) for c in cut), 0.0]
        total -= math.log(tail[y] - tail[y + 1]) / len(rows)
    assert value == pytest.approx(total + ordinal.RIDGE / 2 * float(point[:-2] @ point[:-2]), rel=1e-9)
    for i in [*rows[0][:3], *rows[1][-3:], len(point) - 2, len(point) - 1]:
        step = np.zeros(len(point))
        step[i] = 1e-5
        assert gradient[i] == pytest.approx((ordinal.loss(point + step, own, scale)[0] - ordinal.loss(point - step, own, scale)[0]) / 2e-5, abs=1e-6)
    model = ordinal.fit(rows, grades)
    assert np.count_nonzero(model.weights) == len(np.unique(f))
    tails = model.tails([x.encode() for x in texts])
    assert ((tails > 0.5).sum(axis=1) == grades).mean() > 0.9
    monkeypatch.setattr(ordinal, "PIECE", 64)
    whole_text = " ".join(texts).encode()
    assert ordinal.features([whole_text])[1].tolist() == ordinal.features([whole_text, b""])[1].tolist()
