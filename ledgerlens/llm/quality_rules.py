"""Quality rules with risk-controlled thresholds, natively.

Base rules are fixed. Further rules reject a document when a ratio exceeds a
cutoff. Cutoffs are chosen per stratum (language) on labelled documents that
pass the base rules, in two halves by a hash of the id. On the first half, each
budget of BUDGETS gives every rule the tightest cutoff of GRID that loses at
most an equal share of the budget of good documents. On the second half, the
verdict of all rules together is tested: a budget is certified if the exact
binomial test rejects "it loses more than ALPHA of good documents" at DELTA,
divided by the number of tests (Bonferroni over budgets and strata). Of the
certified budgets, the one that rejects most bad documents of the first half is
taken, the smallest at ties; without one, the rules rest in that stratum. So
with a chance of 1 - DELTA, no stratum loses more than ALPHA of the good
documents that pass the base rules.

Null text has no words. Null or unknown languages form strata like others.
Repeated rows count as often as they occur, repeated labels too; rows and
labels without an id meet no label. Without labels only the base rules work.
An empty table gives an empty one. Columns that begin with two underscores are
for the operator's own use; others pass through as they are called.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import Scratch, sized_broadcast, whole, word_array

MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: At most this share of the good documents of a stratum is lost, but for this chance that some stratum loses more.
ALPHA, DELTA = 0.01, 0.05
#: Shares of good documents that all rules together may lose where cutoffs are chosen.
BUDGETS = [0.001, 0.0025, 0.005, 0.0075]
GRID = [0.02, 0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]
#: Numerator and denominator of each rule's ratio, as fields of base_stats().
RULES = {
    "symbols": ("n_symbols", "n_words"), "exclaims": ("n_exclaims", "n_words"), "upper": ("n_upper", "word_chars"),
    "dup_lines": ("n_dup_lines", "n_lines"), "repeats": ("n_repeat_words", "n_words"),
}
BASE_FIELDS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _let(value: Column, use) -> Column:
    """use(value), with value worked out once."""
    return F.get(F.transform(F.array(value), use), 0)


def _repeated(windows: Column, same) -> Column:
    """Those elements of a sorted array that are the same as a neighbour."""
    return F.filter(windows, lambda x, j: F.coalesce(same(x, F.get(windows, j - 1)), F.lit(False)) | F.coalesce(same(x, F.get(windows, j + 1)), F.lit(False)))


def with_stats(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with __q, a struct of counts, to be written before it is filtered. All work is on the row itself.

    Equal three-word windows are found in two steps: numbers of a hash and, in
    the low bits, the place are sorted, which brings equal hashes together;
    then the windows of equal hashes alone are sorted and compared by words.
    """
    kept = docs.columns
    text = whole(F.col(text_col))
    lines = F.filter(F.split(text, "\n", -1), lambda s: s.rlike(r"[^\x20\x09-\x0D]"))
    odd = F.regexp_replace(text, r"[^#*$%&|<>!A-Z]+", "")
    step = docs.select(*_all(kept), text.alias("__t"), word_array(F.col(text_col)).alias("__w"), lines.alias("__l"), odd.alias("__o"))
    n = F.size("__w")
    step = step.select("*", n.alias("__n"), F.length(F.bin(n.cast("long"))).alias("__bits"))
    bits = F.col("__bits")
    key = lambda x: F.call_function("shiftrightunsigned", x, bits)
    window = lambda i: F.xxhash64(F.get("__w", i), F.get("__w", i + 1), F.get("__w", i + 2))
    packed = F.transform(F.sequence(F.lit(0), F.col("__n") - 3), lambda i: F.call_function("shiftleft", window(i), bits).bitwiseOR(i.cast("long")))
    alike = _let(F.sort_array(packed), lambda s: _repeated(s, lambda x, y: key(x) == key(y)))
    at = lambda x: x.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1).cast("int")
    words = F.transform(alike, lambda x: F.struct(F.array_join(F.slice("__w", at(x) + 1, 3), " ").alias("w"), at(x).alias("i")))
    exact = _let(F.sort_array(words), lambda s: F.sort_array(F.transform(_repeated(s, lambda x, y: x["w"] == y["w"]), lambda x: x["i"])))
    step = step.withColumn("__s", F.when(F.col("__n") >= 4, exact))

    def cover(acc, p):
        return F.struct((p + 3).alias("end"), (acc["n"] + 3 - F.greatest(F.lit(0), acc["end"] - p)).alias("n"))

    zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
    count = lambda characters: (F.length("__o") - F.length(F.translate("__o", characters, ""))).cast("long")
    stats = F.struct(
        F.col("__n").cast("long").alias("n_words"), F.length(F.array_join("__w", "")).cast("long").alias("word_chars"),
        count("#*$%&|<>").alias("n_symbols"), (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
        F.coalesce(F.aggregate("__s", zero, cover, lambda a: a["n"]), F.lit(0).cast("long")).alias("n_repeat_words"),
        F.size("__l").cast("long").alias("n_lines"), count("!").alias("n_exclaims"), count("ABCDEFGHIJKLMNOPQRSTUVWXYZ").alias("n_upper"),
    )
    return step.select(*_all(kept), stats.alias("__q"))


def _all(columns: list[str]) -> list[Column]:
    return [F.col(f"`{c}`") for c in columns]


def base_failed(q: str = "__q") -> Column:
    n = F.col(f"{q}.n_words")
    return (n < MIN_WORDS) | (100 * F.col(f"{q}.n_repeat_words") > MAX_REPEAT_PERCENT * n)


def ratio(rule: str, q: str = "__q") -> Column:
    top, bottom = RULES[rule]
    return F.col(f"{q}.{top}") / F.greatest(F.col(f"{q}.{bottom}"), F.lit(1))


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(Bin(n, p) <= k) where k <= n p, else 1: summed in logarithms, term by term."""

    def add(acc, i):
        term = acc["term"] + F.log((n - i + 1) / i * F.lit(p / (1 - p)))
        most = F.greatest(acc["sum"], term)
        return F.struct(term.alias("term"), (most + F.log1p(F.exp(F.least(acc["sum"], term) - most))).alias("sum"))

    first = n * F.lit(math.log1p(-p))
    terms = F.when(k >= 1, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>"))
    return F.when(k <= n * p, F.exp(F.aggregate(terms, F.struct(first.alias("term"), first.alias("sum")), add, lambda a: a["sum"]))).otherwise(1.0)


def certified_cutoffs(stats: DataFrame, labels: DataFrame, stratum: str = "lang", id_col: str = "doc_id", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """One row per stratum with a certified budget: __stratum and a column per rule (null where it rests).

    stats: id, stratum and __q. The labelled rows are reduced to counts by
    stratum, so what follows is a few rows per stratum.
    """
    spark, scratch = stats.sparkSession, Scratch(stats.sparkSession, "cutoffs")
    marks = labels.select(F.col(id_col).alias("__id"), F.col("quality").alias("__good")).where("quality is not null")
    ratios = [ratio(r).alias(r) for r in RULES]
    held = stats.join(marks, F.col(f"`{id_col}`") == F.col("__id")).where(~base_failed()).select(F.col(stratum).alias("__stratum"), (F.col("__good") == 1).alias("good"), (F.pmod(F.xxhash64(F.lit("holdout"), "__id"), F.lit(2)) == 0).alias("choose"), *ratios)
    held = scratch.keep(held, "held")
    tests = [(r, c) for r in RULES for c in GRID]
    counts = [F.count_if(F.col("good") & (F.col(r) > c)).alias(f"g{i}") for i, (r, c) in enumerate(tests)]
    by = held.where("choose").groupBy("__stratum").agg(F.count_if("good").alias("n"), *counts)

    def tightest(rule, budget):
        fine = [F.when(F.col(f"g{i}") * len(RULES) <= F.lit(budget) * F.col("n"), F.lit(c)) for i, (r, c) in enumerate(tests) if r == rule]
        return F.coalesce(*fine)

    options = F.array(*[F.struct(F.lit(b).alias("budget"), *[tightest(r, b).alias(f"__max_{r}") for r in RULES]) for b in BUDGETS])
    options = scratch.keep(by.where("n > 0").select("__stratum", F.inline(options)), "options")  # a few rows per stratum
    n = options.count()
    lost = F.lit(False)
    for r in RULES:
        lost = lost | F.coalesce(F.col(r) > F.col(f"__max_{r}"), F.lit(False))
    side = options.withColumnRenamed("__stratum", "__of")
    judged_ = held.join(sized_broadcast(side, n), F.col("__stratum").eqNullSafe(F.col("__of"))).withColumn("lost", lost)
    done = judged_.groupBy("__stratum", "budget").agg(
        F.count_if(F.col("good") & ~F.col("choose")).alias("n"), F.count_if(F.col("good") & ~F.col("choose") & F.col("lost")).alias("k"), F.count_if(~F.col("good") & F.col("choose") & F.col("lost")).alias("caught"),
        *[F.first(f"__max_{r}").alias(f"__max_{r}") for r in RULES],
    )
    level = delta / max(1, n)
    safe = done.where(binomial_tail(F.col("k"), F.col("n"), alpha) <= level).where("caught > 0")
    best = safe.groupBy("__stratum").agg(F.max_by(F.struct(*[f"__max_{r}" for r in RULES]), F.struct("caught", -F.col("budget"))).alias("best"))
    return best.select("__stratum", "best.*")


def judged(stats: DataFrame, cutoffs: DataFrame, stratum: str = "lang") -> DataFrame:
    """stats with __base (failed) and __kept."""
    rows = stats.join(sized_broadcast(cutoffs, cutoffs.count()), F.col(stratum).eqNullSafe(F.col("__stratum")), "left")
    fine = F.lit(True)
    for r in RULES:
        fine = fine & F.coalesce(ratio(r) <= F.col(f"__max_{r}"), F.lit(True))
    return rows.withColumn("__base", base_failed()).withColumn("__kept", ~F.col("__base") & fine).drop("__stratum", *[f"__max_{r}" for r in RULES])


def rated(docs: DataFrame, labels: DataFrame, columns: list[str], stratum: str = "lang") -> DataFrame:
    """columns of docs with __q, __base and __kept.

    The statistics are written once: left lazy, the optimiser would copy their
    expressions into every cutoff's test.
    """
    scratch = Scratch(docs.sparkSession, "rules")
    own = [F.col(f"`{c}`") for c in columns]
    stats = scratch.keep(with_stats(docs).select(*own, "__q"), "stats")
    return judged(stats, scratch.keep(certified_cutoffs(stats, labels, stratum), "cutoffs"), stratum)
