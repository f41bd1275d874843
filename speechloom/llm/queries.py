"""Queries of the language-model data operators, over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from speechloom.llm import balanced, groups, languages, leaks, lookalikes, overlaps, spam, tokens
from speechloom.operators import nested
from speechloom.sources.tables import table


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    return overlaps.split_overlaps(table(spark, sf, "mcq_samples"), table(spark, sf, "recordings"))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    a, b = F.col("eval_no"), F.col("train_no")
    return _pairs(spark, sf).select(F.least(a, b).alias("sample_no_a"), F.greatest(a, b).alias("sample_no_b"))


def p2_counts(spark: SparkSession, sf: str) -> DataFrame:
    return overlaps.overlap_counts(_pairs(spark, sf))


def _records(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return table(spark, sf, "recordings"), table(spark, sf, "segments"), table(spark, sf, "mcq_samples")


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return groups.group_members(*_records(spark, sf))


def p3_splits(spark: SparkSession, sf: str) -> DataFrame:
    return groups.assign_splits(groups.related_records(*_records(spark, sf)), table(spark, sf, "split_targets"))


def p3_shares(spark: SparkSession, sf: str) -> DataFrame:
    return groups.split_report(p3_splits(spark, sf), table(spark, sf, "split_targets"))


def _texts(spark: SparkSession, sf: str) -> DataFrame:
    """(record_kind, record_key, text) of segments and question stems."""
    one = table(spark, sf, "segments").where("utt_id is not null").select(F.lit("segment").alias("record_kind"), F.col("utt_id").alias("record_key"), "text")
    stems = nested.jsonl_questions(nested.json_nodes(table(spark, sf, "mcq_jsonl"), "line_no", "jsonl"))
    two = stems.select(F.lit("question").alias("record_kind"), F.concat_ws(":", "line_no", "question_idx").alias("record_key"), F.col("question_stem").alias("text"))
    return one.unionByName(two)


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    texts = _texts(spark, sf)
    bigrams = lookalikes.letter_bigrams(texts.select("text"))
    return lookalikes.canonical_column(texts, "text", bigrams, only_changed=True).select("record_kind", "record_key").distinct()


def p4_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Every text in its consistent form."""
    texts = _texts(spark, sf)
    bigrams = lookalikes.letter_bigrams(texts.select("text"))
    return lookalikes.canonical_column(texts, "text", bigrams).select("record_kind", "record_key", "canonical").distinct()


def p5_stretches(spark: SparkSession, sf: str) -> DataFrame:
    rows = languages.language_rows(table(spark, sf, "segments"), table(spark, sf, "mcq_samples"), table(spark, sf, "language_codes"))
    return languages.text_languages(rows)


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return languages.label_cases(languages.cut(p5_stretches(spark, sf)))


def _target_records(spark: SparkSession, sf: str) -> DataFrame:
    return balanced.cut(balanced.target_records(table(spark, sf, "mcq_samples"), table(spark, sf, "segments"), table(spark, sf, "language_codes")))


def _draw(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return balanced.draw(_target_records(spark, sf), table(spark, sf, "sample_targets"))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return _draw(spark, sf)[1].where("not can_be_met").select("target_field", "category")


def p6_report(spark: SparkSession, sf: str) -> DataFrame:
    return _draw(spark, sf)[1]


def p6_sample(spark: SparkSession, sf: str) -> DataFrame:
    return _draw(spark, sf)[0]


def p6_checks(spark: SparkSession, sf: str) -> DataFrame:
    """The report with what any right draw fulfils instead of its random part: drawn within one of the wanted rows, each record once, none of another category."""
    records, targets = _target_records(spark, sf), table(spark, sf, "sample_targets")
    sample, report = balanced.draw(records, targets)
    keys = ["target_field", "record_key", "category"]
    fair = sample.join(records, keys, "left").groupBy(*keys).agg(F.count("*").alias("n")).groupBy("target_field", "category").agg((F.max("n") == 1).alias("once"))
    wanted = F.least(F.greatest(F.col("target_rows"), F.col("min_rows").cast("double")), F.col("available").cast("double"))
    checked = report.join(fair, ["target_field", "category"], "left")
    return checked.select("target_field", "category", F.col("sample_size").cast("bigint").alias("sample_size"), F.round("target_rows", 6).alias("target_rows"), "available", "can_be_met", (F.abs(F.col("drawn") - wanted) < 1).alias("within_one"), F.coalesce("once", F.lit(True)).alias("each_once"))


def p8_ids(spark: SparkSession, sf: str) -> DataFrame:
    return tokens.token_ids(table(spark, sf, "documents", "doc_id", "text"))


def p9_leaks(spark: SparkSession, sf: str) -> DataFrame:
    return leaks.leaked_items(table(spark, sf, "documents"), table(spark, sf, "eval_items"))


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return p9_leaks(spark, sf).select("doc_id", "item_id")


def p10_shares(spark: SparkSession, sf: str) -> DataFrame:
    return spam.spam_shares(table(spark, sf, "documents"))


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    return spam.spam_pages(table(spark, sf, "documents")).select("doc_id")


QUERIES = {f.__name__: f for f in (p2_found, p2_counts, p3_found, p3_splits, p3_shares, p4_found, p4_texts, p5_found, p5_stretches, p6_found, p6_report, p6_sample, p6_checks, p8_ids, p9_found, p9_leaks, p10_found, p10_shares)}

_FILE = r"lower(regexp_extract(regexp_replace(trim(regexp_replace(regexp_replace(audio_path, '%2[Ff]', '/', 'g'), '[?#].*$', '')), '\.[A-Za-z0-9]{1,5}$', ''), '([^/\\:]+)$', 1))"

_TARGETS = r"""
WITH golds AS (
    SELECT 'gold_choice' AS target_field, sample_id AS k,
           CASE WHEN coalesce(gold_choice, '') = '' THEN NULL
                WHEN list_contains(choice_labels, upper(regexp_replace(gold_choice, '^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$', '', 'g')))
                THEN upper(regexp_replace(gold_choice, '^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$', '', 'g'))
                ELSE list_extract(list_filter(map_keys(choices), lambda x: choices[x] = gold_choice), 1) END AS category
    FROM mcq_samples
), spoken AS (
    SELECT 'language' AS target_field, utt_id AS k, c.code AS category
    FROM segments s LEFT JOIN language_codes c ON lower(trim(s.language)) = c.label
), records AS (
    SELECT target_field, k, min(category) AS category FROM (SELECT * FROM golds UNION ALL SELECT * FROM spoken) WHERE k IS NOT NULL GROUP BY target_field, k
), sizes AS (SELECT target_field, floor(count(*) * 0.2) AS size FROM records GROUP BY target_field),
found AS (SELECT target_field, category, count(*) AS n FROM records GROUP BY target_field, category)
"""

ORACLES = {
    "p3_found": rf"""
WITH RECURSIVE links AS (
    SELECT DISTINCT rec_id, 'session:' || split_part(list_extract(string_split(rec_id, '__'), -1), '_', 1) AS entity FROM recordings
    UNION
    SELECT DISTINCT rec_id, 'speaker:' || lower(trim(speaker)) FROM segments
    WHERE speaker IS NOT NULL AND lower(trim(speaker)) NOT IN ('', 'spk_unk') AND rec_id IN (SELECT rec_id FROM recordings)
), pairs AS (SELECT DISTINCT a.rec_id AS x, b.rec_id AS y FROM links a JOIN links b ON a.entity = b.entity),
reached AS (SELECT rec_id AS x, rec_id AS y FROM recordings UNION SELECT r.x, p.y FROM reached r JOIN pairs p ON r.y = p.x),
labels AS (SELECT x AS rec_id, min(y) AS label, count(DISTINCT y) AS n FROM reached GROUP BY x)
SELECT 'recording' AS record_kind, rec_id AS record_key, label AS group_rec_id FROM labels WHERE n > 1
UNION ALL
SELECT 'sample', CAST(s.sample_no AS VARCHAR), l.label
FROM mcq_samples s JOIN labels l ON {_FILE} = lower(list_extract(string_split(l.rec_id, '__'), -1)) WHERE l.n > 1""",
    "p6_found": _TARGETS + """SELECT t.target_field, t.category FROM sample_targets t
LEFT JOIN sizes z ON z.target_field = t.target_field
LEFT JOIN found f ON f.target_field = t.target_field AND f.category = t.category
WHERE coalesce(f.n, 0) < t.target_share * z.size OR coalesce(f.n, 0) < t.min_rows""",
    "p6_checks": _TARGETS + """
SELECT t.target_field, t.category, CAST(coalesce(z.size, 0) AS BIGINT) AS sample_size, round(t.target_share * coalesce(z.size, 0), 6) AS target_rows, coalesce(f.n, 0) AS available,
       NOT (coalesce(f.n, 0) < t.target_share * coalesce(z.size, 0) OR coalesce(f.n, 0) < t.min_rows) AS can_be_met, true AS within_one, true AS each_once
FROM sample_targets t LEFT JOIN sizes z ON z.target_field = t.target_field
LEFT JOIN found f ON f.target_field = t.target_field AND f.category = t.category""",
}
