"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm import collocations, decontamination, language_id, mixing, near_dedup, ordinal, packing, pii, quality_rules, sharding, suffix_dedup, variants, warc
from ledgerlens.llm.common import table


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What remains of every document without strings of 100 bytes that start earlier."""
    return suffix_dedup.without_repeats(table(spark, sf_dir, "documents"))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of near-duplicates of every document."""
    return near_dedup.classes(table(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document inside occurrences of benchmark windows, by the positional index."""
    return decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("items")


def decontamination_proximity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the three rarest words of a benchmark item within twelve words of each other, by the positional index."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("name"), "text")
    return decontamination.proximity(table(spark, sf_dir, "documents"), items, 12, rarest=3)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to a chunked WARC archive and read back from it."""
    return warc.round_trip(spark, table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    return pii.digest(pii.pii_spans(table(spark, sf_dir, "documents")))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", language_id.held_out())
    model = language_id.train(docs.where("not held_out"))
    return language_id.predict(docs, model, keep=("held_out",))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard of every document."""
    return sharding.shard(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule statistics and verdict of every document."""
    done = quality_rules.rated(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), table(spark, sf_dir, "labels"), ["doc_id", "lang"])
    return done.select("doc_id", *[F.col(f"__q.{c}") for c in quality_rules.BASE_FIELDS], F.col("__base").alias("base_failed"), F.col("__kept").alias("kept"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected grade and tail probabilities of every document."""
    docs = table(spark, sf_dir, "documents")
    return ordinal.grade(docs, ordinal.train(docs, table(spark, sf_dir, "labels")))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of every document the mix takes."""
    docs = mixing.with_copies(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    rows = mixing.with_taken(docs, mixing.cuts(spark, docs))
    return rows.select("doc_id", F.col("__size").alias("size"), F.col("__cut.source_size").alias("source_size"), F.col("__cut.target").alias("target"), (F.col("__size") * F.col("__times")).alias("taken"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents, some of them spoiled by a hash, with the more frequent words that they are variants of."""
    return variants.variants(variants.dictionary(table(spark, sf_dir, "documents"), spoil=variants.SPOIL))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best phrases of each language."""
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of every piece of every document in packed sequences."""
    return packing.pack(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_suffix_dedup, op2_near_dedup, op3_decontamination, decontamination_proximity, op4_warc, op5_pii, op6_language_id, op7_sharding, op8_quality_rules, op9_quality_classifier, op10_mixing, op11_spelling_variants, op12_collocations, op13_packing)}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


#: The words of a text, for op3.
SQL_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

SQL = {
    "op1_suffix_dedup": """
        WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
             w AS (SELECT doc_id, i, array_slice(b, i + 1, i + 100) AS s FROM d, unnest(range(0, greatest(n - 99, 0))) AS t(i)),
             r AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id NULLS FIRST, i) AS k FROM w) WHERE k > 1),
             g AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100 THEN 0 ELSE 1 END AS new FROM r),
             h AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM g),
             s AS (SELECT doc_id, min(i) AS a, max(i) + 100 AS e FROM h GROUP BY doc_id, run),
             u AS (SELECT doc_id, sum(e - a) AS removed, count(*) AS spans FROM s GROUP BY doc_id),
             c AS (SELECT doc_id, a AS upto, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY a), 0) AS begin FROM s
                   UNION ALL SELECT d.doc_id, d.n, coalesce(max(s.e), 0) FROM d LEFT JOIN s ON d.doc_id IS NOT DISTINCT FROM s.doc_id GROUP BY d.doc_id, d.n),
             k AS (SELECT c.doc_id, string_agg(hex(array_slice(d.b, begin + 1, upto)), '' ORDER BY begin) AS kept FROM c JOIN d ON c.doc_id IS NOT DISTINCT FROM d.doc_id WHERE upto > begin GROUP BY c.doc_id)
        SELECT d.doc_id, d.n::BIGINT AS n_bytes, coalesce(u.removed, 0)::BIGINT AS n_removed, coalesce(u.spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(k.kept, ''))) AS kept_sha256
        FROM d LEFT JOIN u ON d.doc_id IS NOT DISTINCT FROM u.doc_id LEFT JOIN k ON d.doc_id IS NOT DISTINCT FROM k.doc_id
""",
    "op3_decontamination": f"""
        WITH b AS (SELECT item_id::VARCHAR AS item, {SQL_WORDS} AS w FROM benchmark),
             bw AS (SELECT DISTINCT item, least(10, len(w)) AS n, array_to_string(w[i + 1 : i + least(10, len(w))], ' ') AS s FROM b, unnest(range(0, len(w) - least(10, len(w)) + 1)) AS t(i) WHERE len(w) > 0),
             sizes AS (SELECT DISTINCT n FROM bw),
             d AS (SELECT doc_id, {SQL_WORDS} AS w FROM documents),
             o AS (SELECT doc_id, i, bw.n, item FROM (SELECT doc_id, n, i, array_to_string(w[i + 1 : i + n], ' ') AS s FROM d, sizes, unnest(range(0, greatest(len(w) - n + 1, 0))) AS t(i)) x JOIN bw ON x.n = bw.n AND x.s = bw.s),
             p AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM o, unnest(range(i, i + n)) AS t(q) GROUP BY doc_id),
             it AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM o WHERE item IS NOT NULL) GROUP BY doc_id)
        SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN p ON d.doc_id IS NOT DISTINCT FROM p.doc_id LEFT JOIN it ON d.doc_id IS NOT DISTINCT FROM it.doc_id
""",
    "op4_warc": """
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b, sha256(coalesce(html, '')) AS d FROM pages),
             f AS (SELECT d, min(page_id) AS first FROM p WHERE octet_length(b) >= 100 GROUP BY d)
        SELECT p.page_id, octet_length(b)::BIGINT AS payload_bytes, p.d AS payload_digest,
               CASE WHEN f.first IS NULL OR f.first IS NOT DISTINCT FROM p.page_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN f.first IS NULL OR f.first IS NOT DISTINCT FROM p.page_id THEN NULL ELSE f.first END AS refers_to,
               true AS intact
        FROM p LEFT JOIN f ON p.d = f.d
    """,
    "op11_spelling_variants": r"""
        WITH RECURSIVE
             steps AS (SELECT i::BIGINT AS i, i::BIGINT AS c, 0 AS k FROM range(256) t(i) UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM steps WHERE k < 8),
             tab AS (SELECT list(c ORDER BY i) AS t FROM steps WHERE k = 8),
             runs AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS w FROM documents),
             long AS (SELECT doc_id, w, encode(coalesce(doc_id::VARCHAR, '') || ':' || w) AS b FROM runs WHERE length(w) >= 7),
             hashed AS (SELECT doc_id, w, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, octet_length(b) + 1), lambda i: ('0x' || hex(array_slice(b, i, i)))::BIGINT)), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295::BIGINT) AS h FROM long, tab),
             spoiled AS (SELECT doc_id, w, CASE WHEN h % 31 = 0 THEN substr(w, 1, (h % length(w))::INT) || substr(w, (h % length(w))::INT + 2) ELSE w END AS word FROM hashed),
             times AS (SELECT doc_id, w, count(*) AS k FROM (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS w FROM documents) GROUP BY doc_id, w),
             words AS (SELECT word, sum(k)::BIGINT AS n FROM spoiled JOIN times ON spoiled.w = times.w AND spoiled.doc_id IS NOT DISTINCT FROM times.doc_id WHERE length(word) >= 7 GROUP BY word HAVING sum(k) >= 2),
             gone AS (SELECT word, i, substr(word, 1, i) || substr(word, i + 2) AS v FROM words, unnest(range(0, length(word))) AS t(i)),
             near AS (SELECT DISTINCT a.word, b.word AS other FROM gone a JOIN gone b ON a.i = b.i AND a.v = b.v AND a.word <> b.word
                      UNION SELECT DISTINCT gone.word, words.word FROM gone JOIN words ON gone.v = words.word
                      UNION SELECT DISTINCT words.word, gone.word FROM gone JOIN words ON gone.v = words.word),
             best AS (SELECT a.word, count(*) AS n_near, first(near.other ORDER BY b.n DESC, b.word) AS other, max(b.n) AS other_n, any_value(a.n) AS n FROM near JOIN words a ON near.word = a.word JOIN words b ON near.other = b.word GROUP BY a.word),
             forms AS (SELECT word, other AS form, other_n AS form_n FROM best WHERE other_n >= 10 * n),
             chain AS (SELECT word, word AS root, 0 AS k FROM words UNION ALL SELECT chain.word, forms.form, k + 1 FROM chain JOIN forms ON chain.root = forms.word),
             ends AS (SELECT word, last(root ORDER BY k) AS root FROM chain GROUP BY word)
        SELECT w.word, form, root, w.n, coalesce(n_near, 0)::BIGINT AS n_near, form_n
        FROM words w LEFT JOIN best ON w.word = best.word LEFT JOIN forms ON w.word = forms.word JOIN ends ON w.word = ends.word
    """,
    "op12_collocations": r"""
        WITH d AS (SELECT coalesce(lang, 'und') AS lang, string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS p FROM documents),
             p AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (SELECT lang, unnest(p) AS piece FROM d)),
             g AS (SELECT lang, k, array_to_string(w[i + 1 : i + k], ' ') AS phrase FROM p, range(1, 6) AS t(k), unnest(range(0, greatest(len(w) - k + 1, 0))) AS u(i)),
             f AS (SELECT lang, k, phrase, count(*) AS f, string_split(phrase, ' ') AS w FROM g GROUP BY lang, k, phrase HAVING count(*) >= 100),
             n AS (SELECT lang, count(*) AS n FROM g WHERE k = 1 GROUP BY lang),
             inner_ AS (SELECT lang, array_to_string(w[i + 1 : i + j], ' ') AS phrase, max(f) AS over FROM f, range(2, 5) AS t(j), unnest(range(0, greatest(k - j + 1, 0))) AS u(i) WHERE j < k GROUP BY 1, 2),
             own AS (SELECT f.* FROM f LEFT JOIN inner_ i ON f.lang = i.lang AND f.phrase = i.phrase WHERE k >= 2 AND (over IS NULL OR over < f)),
             cut AS (SELECT o.lang, o.phrase, o.f AS a, c, x.f AS l, y.f AS r, n.n, (1000::HUGEINT * o.f * n.n) // (x.f::HUGEINT * y.f) AS score
                     FROM (SELECT own.*, unnest(range(1, k)) AS c FROM own) o JOIN n ON n.lang = o.lang
                     JOIN f x ON x.lang = o.lang AND x.phrase = array_to_string(o.w[1 : c], ' ') JOIN f y ON y.lang = o.lang AND y.phrase = array_to_string(o.w[c + 1 :], ' ')),
             low AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1),
             ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM low)
        SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM ranked WHERE rank <= 2000
    """,
}
