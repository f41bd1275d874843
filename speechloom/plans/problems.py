"""Queries of the general data-pipeline operators, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from speechloom.operators import intervals, nested
from speechloom.sources.tables import table


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return intervals.speech_periods(table(spark, sf, "segments"), table(spark, sf, "recordings"))


def p1_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Periods, speech and gaps of each recording, in centiseconds."""
    kind, size = F.col("kind"), F.col("end_cs") - F.col("start_cs")
    return p1_found(spark, sf).groupBy("rec_id").agg(
        F.count(F.when(kind == "period", 1)).alias("periods"),
        F.coalesce(F.sum(F.when(kind == "period", size)), F.lit(0).cast("bigint")).alias("speech_cs"),
        F.coalesce(F.sum(F.when(kind == "gap", size)), F.lit(0).cast("bigint")).alias("gap_cs"),
    )


def _nodes(spark: SparkSession, sf: str) -> DataFrame:
    return nested.json_nodes(table(spark, sf, "mcq_jsonl"), "line_no", "jsonl")


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return nested.option_labels(_nodes(spark, sf))


def p7_records(spark: SparkSession, sf: str) -> DataFrame:
    return nested.jsonl_records(_nodes(spark, sf))


def p7_questions(spark: SparkSession, sf: str) -> DataFrame:
    return nested.jsonl_questions(_nodes(spark, sf))


def p7_options(spark: SparkSession, sf: str) -> DataFrame:
    return nested.jsonl_options(_nodes(spark, sf))


def p7_paths(spark: SparkSession, sf: str) -> DataFrame:
    return nested.schema_paths(_nodes(spark, sf))


def p7_rejects(spark: SparkSession, sf: str) -> DataFrame:
    return nested.unreadable(table(spark, sf, "mcq_jsonl"), "line_no", "jsonl")


QUERIES = {f.__name__: f for f in (p1_found, p1_totals, p7_found, p7_records, p7_questions, p7_options, p7_paths, p7_rejects)}

_PERIODS = """
WITH bounds AS (
    SELECT s.rec_id, CAST(round(s.start_sec * 100) AS BIGINT) AS a,
           CAST(round(CASE WHEN s.end_sec = -1 THEN r.duration_sec ELSE s.end_sec END * 100) AS BIGINT) AS b
    FROM segments s LEFT JOIN recordings r ON s.rec_id = r.rec_id
    WHERE isfinite(s.start_sec) AND isfinite(s.end_sec) AND isfinite(coalesce(CASE WHEN s.end_sec = -1 THEN r.duration_sec ELSE s.end_sec END, 'nan'))
), valid AS (SELECT * FROM bounds WHERE b > a),
seen AS (SELECT *, max(b) OVER (PARTITION BY rec_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM valid),
islands AS (SELECT *, sum(CASE WHEN before IS NULL OR a > before THEN 1 ELSE 0 END) OVER (PARTITION BY rec_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS island FROM seen),
periods AS (SELECT rec_id, island, min(a) AS a, max(b) AS b FROM islands GROUP BY rec_id, island),
found AS (
    SELECT rec_id, 'period' AS kind, a AS start_cs, b AS end_cs FROM periods
    UNION ALL
    SELECT rec_id, 'gap', earlier, a FROM (SELECT *, lag(b) OVER (PARTITION BY rec_id ORDER BY island) AS earlier FROM periods)
    WHERE a - earlier <= 60000
)
"""

ORACLES = {
    "p1_found": _PERIODS + "SELECT rec_id, kind, start_cs, end_cs FROM found",
    "p1_totals": _PERIODS
    + """SELECT rec_id, count(*) FILTER (WHERE kind = 'period') AS periods,
    CAST(coalesce(sum(end_cs - start_cs) FILTER (WHERE kind = 'period'), 0) AS BIGINT) AS speech_cs,
    CAST(coalesce(sum(end_cs - start_cs) FILTER (WHERE kind = 'gap'), 0) AS BIGINT) AS gap_cs FROM found GROUP BY rec_id""",
}
