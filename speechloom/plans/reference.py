"""Queries of the speech and question operators over whole tables, and their SQL.

The tables hold no model output, so predictions are made by arithmetic on row numbers: any engine makes the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from speechloom.functions import text as tx
from speechloom.functions import timeref
from speechloom.operators import aggregates as agg
from speechloom.operators import corpora, intervals, joins, mcq, metrics, sampling, validity
from speechloom.sources.tables import table

LETTERS = ["A", "B", "C", "D"]
QUERIES = {}
ORACLES = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def _predictions(spark: SparkSession, sf: str) -> DataFrame:
    k = (F.col("sample_no") * 7 + 3) % 5
    pred = F.when(k < 4, F.substring(F.lit("ABCD"), (k + 1).cast("int"), F.lit(1)))
    rows = table(spark, sf, "mcq_samples").select("sample_no", "split", "source", "language", "audio_path", F.col("metadata.difficulty").alias("difficulty"), F.col("metadata.category").alias("category"), F.upper(F.trim("gold_choice")).alias("gold"), pred.alias("pred"), F.when(k == 4, "timeout").alias("error"))
    return rows.withColumn("second", F.substring(F.lit("ABCD"), (F.col("sample_no") * 3 % 4 + 1).cast("int"), F.lit(1))).withColumn("is_correct", F.col("pred") == F.col("gold"))


_PREDS = """WITH preds AS (
    SELECT *, pred = gold AS is_correct FROM (
        SELECT sample_no, split, source, language, audio_path, metadata.difficulty AS difficulty, metadata.category AS category, upper(trim(gold_choice)) AS gold,
               CASE WHEN (sample_no * 7 + 3) % 5 < 4 THEN substr('ABCD', CAST((sample_no * 7 + 3) % 5 + 1 AS INT), 1) END AS pred,
               CASE WHEN (sample_no * 7 + 3) % 5 = 4 THEN 'timeout' END AS error,
               substr('ABCD', CAST(sample_no * 3 % 4 + 1 AS INT), 1) AS second
        FROM mcq_samples))
"""
_OK = "CAST(sum(CASE WHEN is_correct THEN 1 ELSE 0 END) AS BIGINT)"


# aggregates


@query(_PREDS + f"""SELECT category, count(*) AS n_total, {_OK} AS n_correct, round({_OK} / count(*), 6) AS accuracy
FROM preds WHERE error IS NULL AND coalesce(category, '') != '' GROUP BY category""")
def q_agg_accuracy_by_category(spark, sf):
    return agg.accuracy_by(_predictions(spark, sf), "category")


@query(_PREDS + f"""SELECT field, value, count(*) AS n_total, {_OK} AS n_correct, round({_OK} / count(*), 6) AS accuracy FROM (
    SELECT 'split' AS field, split AS value, is_correct FROM preds WHERE error IS NULL UNION ALL
    SELECT 'source', source, is_correct FROM preds WHERE error IS NULL UNION ALL
    SELECT 'difficulty', difficulty, is_correct FROM preds WHERE error IS NULL)
WHERE coalesce(value, '') != '' GROUP BY field, value""")
def q_agg_breakdowns(spark, sf):
    return agg.accuracy_breakdowns(_predictions(spark, sf), ["split", "source", "difficulty"])


@query(_PREDS + f"""SELECT count(*) AS n_total, count(*) FILTER (WHERE error IS NULL) AS n_answered, {_OK} AS n_correct,
round({_OK} / count(*), 6) AS accuracy_all, round({_OK} / count(*) FILTER (WHERE error IS NULL), 6) AS accuracy_answered FROM preds""")
def q_agg_overall(spark, sf):
    return agg.overall_accuracy(_predictions(spark, sf))


@query(_PREDS + f"""SELECT count(*) AS folds, round(CAST(sum(ok) AS DOUBLE) / sum(n), 6) AS micro, round(avg(ok / n), 6) AS macro
FROM (SELECT source, count(*) AS n, {_OK} AS ok FROM preds WHERE source IS NOT NULL GROUP BY source)""")
def q_agg_micro_macro(spark, sf):
    return agg.micro_macro(_predictions(spark, sf), "source")


@query(_PREDS + """SELECT label, n, round(100.0 * n / sum(n) OVER (), 6) AS percent FROM (
SELECT l.label, count(p.pred) AS n FROM (VALUES ('A'), ('B'), ('C'), ('D')) l(label) LEFT JOIN preds p ON p.pred = l.label GROUP BY l.label)""")
def q_agg_label_histogram(spark, sf):
    return agg.label_histogram(_predictions(spark, sf), "pred", LETTERS)


@query(_PREDS + """SELECT l.label, count(p.gold) AS n_gold, round(CAST(sum(CASE WHEN p.pred = p.gold THEN 1 ELSE 0 END) AS DOUBLE) / nullif(count(p.gold), 0), 6) AS recall
FROM (VALUES ('A'), ('B'), ('C'), ('D')) l(label) LEFT JOIN preds p ON p.gold = l.label GROUP BY l.label""")
def q_agg_class_recall(spark, sf):
    return agg.class_recall(_predictions(spark, sf), "gold", "pred", LETTERS)


@query("SELECT coalesce(lang, 'unknown') AS lang, count(*) AS n FROM documents GROUP BY 1")
def q_agg_language_counts(spark, sf):
    return agg.value_counts(table(spark, sf, "documents"), "lang")


@query(_PREDS + """SELECT source, n, round(a / n, 6) AS accuracy_first, round(b / n, 6) AS accuracy_second FROM (
SELECT CASE WHEN grouping(source) = 1 THEN 'all' ELSE coalesce(source, 'unknown') END AS source, count(*) AS n,
sum(CASE WHEN pred = gold THEN 1 ELSE 0 END) AS a, sum(CASE WHEN second = gold THEN 1 ELSE 0 END) AS b
FROM preds GROUP BY GROUPING SETS ((source), ()))""")
def q_agg_compare_predictions(spark, sf):
    return agg.compare_predictions(_predictions(spark, sf), "source", "gold", "pred", "second")


@query(_PREDS + """SELECT (SELECT count(*) FROM preds WHERE pred IS DISTINCT FROM second) AS changed, l.label,
(SELECT count(*) FROM preds WHERE pred = l.label) AS n_before, (SELECT count(*) FROM preds WHERE second = l.label) AS n_after
FROM (VALUES ('A'), ('B'), ('C'), ('D')) l(label)""")
def q_agg_changed_labels(spark, sf):
    return agg.changed_labels(_predictions(spark, sf), "pred", "second", LETTERS)


@query("""SELECT count(*) AS n, round(sum(duration_sec), 6) AS duration_sec, CAST(sum(words) AS BIGINT) AS words, round(avg(elapsed / nullif(duration_sec, 0)), 6) AS mean_rt_factor,
round(sum(words) * 60.0 / sum(duration_sec), 6) AS words_per_minute FROM (
SELECT r.rec_id, r.duration_sec, coalesce(w.words, 0) AS words, r.duration_sec / 4 + 1 AS elapsed FROM recordings r LEFT JOIN (
    SELECT rec_id, sum(len(string_split(trim(text), ' '))) AS words FROM segments WHERE trim(text) != '' GROUP BY rec_id) w ON r.rec_id = w.rec_id
WHERE r.duration_sec IS NOT NULL)""")
def q_agg_run_summary(spark, sf):
    words = table(spark, sf, "segments").where("trim(text) != ''").groupBy("rec_id").agg(F.sum(F.size(F.split(F.trim("text"), " "))).alias("words"))
    rows = table(spark, sf, "recordings").where("duration_sec is not null").join(words, "rec_id", "left").fillna(0, ["words"])
    return agg.run_summary(rows.withColumn("elapsed", F.col("duration_sec") / 4 + 1), "duration_sec", "words", "elapsed")


_REASONS = """array_to_string(list_filter([CASE WHEN start_sec IS NULL OR end_sec IS NULL THEN 'null_bound' END,
CASE WHEN isnan(start_sec) OR isnan(end_sec) OR isinf(start_sec) OR isinf(end_sec) THEN 'not_finite' END,
CASE WHEN isfinite(start_sec) AND isfinite(end_sec) AND end_sec != -1 AND end_sec <= start_sec THEN 'reversed' END, CASE WHEN coalesce(trim(text), '') = '' THEN 'no_text' END], lambda x: x IS NOT NULL), '|')"""


def _reasons(spark, sf):
    reasons = validity.segment_reasons(F.col("start_sec"), F.col("end_sec"), F.col("text"))
    return table(spark, sf, "segments").select("utt_id", reasons.alias("reasons"))


@query(f"""SELECT reason, count(*) AS n FROM (SELECT unnest(string_split(r, '|')) AS reason FROM (SELECT {_REASONS} AS r FROM segments)) WHERE reason != '' GROUP BY reason""")
def q_agg_reason_counts(spark, sf):
    return agg.split_reason_counts(_reasons(spark, sf), "reasons")


def _logs(spark, sf):
    """The events as training logs: a run for each user, purchases as saves."""
    return table(spark, sf, "events").select(F.col("user_id").alias("run"), F.col("event_id").alias("step"), F.col("value").alias("loss"), (F.col("event_type") == "purchase").alias("is_save"), F.when(F.col("event_type") == "click", F.col("value") - 50).alias("gap"))


@query("""WITH logs AS (SELECT user_id AS run, event_id AS step, value AS loss, CASE WHEN event_type = 'click' THEN value - 50 END AS gap FROM events),
ranked AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY step DESC) AS r, row_number() OVER (PARTITION BY run ORDER BY CASE WHEN gap IS NULL THEN 1 ELSE 0 END, abs(gap), step) AS g FROM logs)
SELECT run, count(*) AS n_logs, max(step) AS last_step, max(CASE WHEN r = 1 THEN loss END) AS last_loss, max(CASE WHEN g = 1 AND gap IS NOT NULL THEN step END) AS best_step FROM ranked GROUP BY run""")
def q_agg_leaderboard(spark, sf):
    return agg.leaderboard(_logs(spark, sf), "run", "step", "gap", "loss")


# joins


@query("""SELECT s.utt_id, s.rec_id, r.audio_path, coalesce(nullif(lower(trim(coalesce(s.language, r.language))), ''), 'unknown') AS language, s.text
FROM segments s JOIN recordings r ON s.rec_id = r.rec_id WHERE s.text IS NOT NULL""")
def q_join_segment_references(spark, sf):
    return joins.segment_references(table(spark, sf, "segments"), table(spark, sf, "recordings"))


@query("""WITH files AS (SELECT list_extract(string_split(rec_id, '__'), -1) AS file, rec_id FROM recordings),
sessions AS (SELECT split_part(file, '_', 1) AS session, min(rec_id) AS rec_id FROM files GROUP BY 1 HAVING count(*) = 1),
docs AS (SELECT doc_id, session_id, session_id || '_001_studio' AS guess FROM documents)
SELECT d.doc_id, coalesce(s.rec_id, f.rec_id) AS rec_id FROM docs d LEFT JOIN sessions s ON d.session_id = s.session LEFT JOIN files f ON d.guess = f.file""")
def q_join_fallback_chain(spark, sf):
    files = table(spark, sf, "recordings").select(F.element_at(F.split("rec_id", "__"), -1).alias("file"), "rec_id").withColumn("session", F.split("file", "_")[0])
    docs = table(spark, sf, "documents").select("doc_id", "session_id")
    return joins.with_fallback(docs, [(files, "session", F.col("session_id")), (files, "file", F.concat("session_id", F.lit("_001_studio")))], "rec_id").select("doc_id", "rec_id")


@query("""WITH listed AS (SELECT DISTINCT lower(rec_id) AS name FROM recordings WHERE sampling_rate = 8000 UNION SELECT lower(list_extract(string_split(rec_id, '__'), -1)) FROM recordings WHERE sampling_rate = 16000)
SELECT utt_id, ingested_at FROM segments WHERE lower(rec_id) IN (SELECT name FROM listed) OR lower(list_extract(string_split(rec_id, '__'), -1)) IN (SELECT name FROM listed)""")
def q_join_allow_list(spark, sf):
    rec = table(spark, sf, "recordings")
    names = rec.where("sampling_rate = 8000").select(F.col("rec_id").alias("name")).unionByName(rec.where("sampling_rate = 16000").select(F.element_at(F.split("rec_id", "__"), -1).alias("name")))
    keys = [F.lower("rec_id"), F.lower(F.element_at(F.split("rec_id", "__"), -1))]
    return joins.allowed(table(spark, sf, "segments").select("utt_id", "rec_id", "ingested_at"), names, "name", keys).select("utt_id", "ingested_at")


@query("""WITH a AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r, count(*) OVER (PARTITION BY user_id) AS n FROM events WHERE event_type = 'click'),
b AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r, count(*) OVER (PARTITION BY user_id) AS n FROM events WHERE event_type = 'view')
SELECT a.user_id, CAST(a.r AS BIGINT) AS rank, a.event_id AS left_event_id, b.event_id AS right_event_id FROM a JOIN b ON a.user_id = b.user_id AND a.r = b.r AND a.n = b.n""")
def q_join_rank_aligned(spark, sf):
    events = table(spark, sf, "events").select("user_id", "event_id", "event_type")
    left, right = (events.where(F.col("event_type") == x).drop("event_type") for x in ("click", "view"))
    return joins.rank_aligned(left, right, ["user_id"], "event_id").withColumn("rank", F.col("rank").cast("bigint"))


@query("""WITH w AS (SELECT rec_id, start_sec AS lo, end_sec AS hi FROM segments WHERE isfinite(start_sec) AND isfinite(end_sec) AND end_sec >= start_sec),
p AS (SELECT rec_id, duration_sec / 2 AS mid FROM recordings WHERE duration_sec IS NOT NULL)
SELECT rec_id, mid, lo, hi FROM (SELECT p.rec_id, p.mid, w.lo, w.hi, row_number() OVER (PARTITION BY p.rec_id, p.mid ORDER BY w.lo, w.hi) AS r
FROM p JOIN w ON p.rec_id = w.rec_id AND p.mid BETWEEN w.lo AND w.hi) WHERE r = 1""")
def q_join_point_in_window(spark, sf):
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    windows = table(spark, sf, "segments").where(finite("start_sec") & finite("end_sec")).select("rec_id", F.col("start_sec").alias("lo"), F.col("end_sec").alias("hi"))
    points = table(spark, sf, "recordings").where("duration_sec is not null").select("rec_id", (F.col("duration_sec") / 2).alias("mid"))
    return joins.in_windows(points, windows, "rec_id", "mid", "lo", "hi", 600.0)


@query(_PREDS + """, d AS (SELECT source, avg(CASE WHEN is_correct THEN 1.0 ELSE 0.0 END) AS m FROM preds WHERE split = 'dev' GROUP BY source),
t AS (SELECT source, avg(CASE WHEN is_correct THEN 1.0 ELSE 0.0 END) AS m FROM preds WHERE split = 'test' AND source != 'translated' GROUP BY source)
SELECT coalesce(d.source, t.source) AS source, round(d.m, 6) AS first, round(t.m, 6) AS second, round((round(t.m, 6) - round(d.m, 6)) * 100, 6) AS delta_pp FROM d FULL JOIN t ON d.source = t.source""")
def q_join_compare_splits(spark, sf):
    rows = _predictions(spark, sf)
    mean = F.round(F.avg(F.when(F.col("is_correct"), 1.0).otherwise(0.0)), 6).alias("m")
    dev = rows.where("split = 'dev'").groupBy("source").agg(mean)
    test = rows.where("split = 'test' and source != 'translated'").groupBy("source").agg(mean)
    return joins.compare_metrics(dev, test, "source", "m")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def q_join_complement(spark, sf):
    returned = table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf, "orders", "o_orderkey", "o_totalprice").join(returned, "o_orderkey", "left_anti")


@query("""SELECT r.rec_id, CASE WHEN a.audio_path IS NOT NULL THEN a.audio_path ELSE b.audio_path END AS audio_path FROM recordings r
LEFT JOIN (SELECT DISTINCT audio_path FROM mcq_samples) a ON a.audio_path = r.audio_path
LEFT JOIN (SELECT DISTINCT audio_path FROM mcq_samples) b ON b.audio_path = list_extract(string_split(r.audio_path, '/'), -1)""")
def q_join_candidate_paths(spark, sf):
    rec = table(spark, sf, "recordings").select("rec_id", F.col("audio_path").alias("own"))
    return joins.candidate_paths(rec, "rec_id", [F.col("own"), F.element_at(F.split("own", "/"), -1)], table(spark, sf, "mcq_samples"), "audio_path")


# sampling, sharding, windows


@query("""SELECT source, sample_no, CAST(r AS BIGINT) AS rank FROM (SELECT source, sample_no, row_number() OVER (PARTITION BY source ORDER BY md5('7|' || sample_no), sample_no) AS r FROM mcq_samples) WHERE r <= 20""")
def q_sample_per_source(spark, sf):
    return sampling.first_n_per_group(table(spark, sf, "mcq_samples").select("source", "sample_no"), ["source"], "sample_no", 20, 7).withColumn("rank", F.col("rank").cast("bigint"))


@query("""SELECT sample_no, source, row_number() OVER (PARTITION BY source ORDER BY md5('3|' || sample_no), sample_no)
<= least(greatest(round_even(count(*) OVER (PARTITION BY source) * 0.15, 0), 1), count(*) OVER (PARTITION BY source) - 1) AS is_eval FROM mcq_samples""")
def q_sample_train_eval(spark, sf):
    return sampling.train_eval_split(table(spark, sf, "mcq_samples").select("sample_no", "source"), "sample_no", 0.15, 3, ["source"])


@query("""WITH r AS (SELECT rec_id, language, row_number() OVER (PARTITION BY language ORDER BY md5('5|' || rec_id), rec_id) AS k, count(*) OVER (PARTITION BY language) AS n FROM recordings),
p AS (SELECT *, greatest(round_even(n * 0.15, 0), 1) AS t0, greatest(round_even(n * 0.15, 0), 1) AS v0 FROM r),
q AS (SELECT *, greatest(least(v0, n - 1 - t0), 0) AS v FROM p), s AS (SELECT *, least(t0, n - 1 - v) AS t FROM q)
SELECT rec_id, language, CASE WHEN n <= 2 OR k <= t THEN 'test' WHEN k <= t + v THEN 'validation' ELSE 'train' END AS part FROM s""")
def q_sample_stratified(spark, sf):
    return sampling.stratified_partitions(table(spark, sf, "recordings").select("rec_id", "language"), "language", "rec_id", 0.15, 0.15, 5)


@query("""WITH c AS (SELECT coalesce(lang, 'unknown') AS label, count(*) AS n FROM documents GROUP BY 1), e AS (SELECT label, n * 997.0 / sum(n) OVER () AS x FROM c),
b AS (SELECT label, floor(x + 1e-9) AS base, round(greatest(x - floor(x + 1e-9), 0), 9) AS rest FROM e)
SELECT label, CAST(base + CASE WHEN row_number() OVER (ORDER BY rest DESC, label) <= 997 - sum(base) OVER () THEN 1 ELSE 0 END AS BIGINT) AS n FROM b""")
def q_sample_largest_remainder(spark, sf):
    counts = table(spark, sf, "documents").groupBy(F.coalesce("lang", F.lit("unknown")).alias("label")).agg(F.count("*").alias("share"))
    return sampling.largest_remainder(counts, "label", "share", 997)


@query("""WITH c AS (SELECT source AS label, count(*) AS pooled, count(*) FILTER (WHERE split = 'test') AS have FROM mcq_samples GROUP BY 1),
b AS (SELECT label, have, CAST(least(round_even(CAST(pooled AS DOUBLE) / sum(pooled) OVER () * 120, 0), have) AS BIGINT) AS n FROM c),
m AS (SELECT *, greatest(120 - sum(n) OVER (), 0) AS missing, coalesce(sum(have - n) OVER (ORDER BY have - n DESC, label ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM b)
SELECT label, CAST(n + greatest(least(have - n, missing - before), 0) AS BIGINT) AS n FROM m""")
def q_sample_quota_refill(spark, sf):
    counts = table(spark, sf, "mcq_samples").groupBy(F.col("source").alias("label")).agg(F.count("*").alias("pooled"), F.count(F.when(F.col("split") == "test", 1)).alias("have"))
    return sampling.quota_with_refill(counts, "label", "pooled", "have", 120)


@query("""WITH r AS (SELECT sample_no, source, source = 'translated' AS target, row_number() OVER (PARTITION BY source = 'translated' ORDER BY md5('1|' || sample_no), sample_no) AS k, count(*) OVER (PARTITION BY source = 'translated') AS n FROM mcq_samples),
c AS (SELECT *, CASE WHEN target THEN floor(ceil(n * 2.5) / n) + CASE WHEN k <= ceil(n * 2.5) % n THEN 1 ELSE 0 END ELSE 1 END AS copies FROM r)
SELECT sample_no, source, unnest(generate_series(1, CAST(copies AS BIGINT))) AS copy FROM c""")
def q_sample_upsample(spark, sf):
    return sampling.upsample(table(spark, sf, "mcq_samples").select("sample_no", "source"), "sample_no", F.col("source") == "translated", 2.5, 1)


@query("""SELECT label, vec_id, i, v FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY abs(v) DESC, i) AS r, count(*) OVER (PARTITION BY vec_id) AS n FROM (
SELECT label, vec_id, unnest(generate_series(0, len(embedding) - 1)) AS i, unnest(embedding) AS v FROM embeddings) WHERE v != 0) WHERE r <= greatest(ceil(n * 0.05), 1)""")
def q_sample_top_magnitudes(spark, sf):
    long = table(spark, sf, "embeddings").select("label", "vec_id", F.posexplode("embedding").alias("i", "v"))
    return sampling.top_magnitudes(long, "vec_id", "i", "v", 0.05).withColumn("i", F.col("i").cast("bigint"))


@query("""SELECT session, CAST(floor((row_number() OVER (ORDER BY first) - 1) * 4 / count(*) OVER ()) AS BIGINT) AS shard FROM (
SELECT session_id AS session, min(doc_id) AS first FROM documents WHERE session_id IS NOT NULL GROUP BY 1)""")
def q_shard_sessions(spark, sf):
    docs = table(spark, sf, "documents").where("session_id is not null").select(F.col("session_id").alias("session"), "doc_id")
    return sampling.session_shards(docs, "session", "doc_id", 4)


@query("SELECT doc_id, CAST(ntile(7) OVER (ORDER BY doc_id) - 1 AS BIGINT) AS shard FROM documents")
def q_shard_contiguous(spark, sf):
    return sampling.contiguous_shards(table(spark, sf, "documents").select("doc_id"), ["doc_id"], 7)


@query("""SELECT rec_id, CAST((row_number() OVER (ORDER BY md5('2|' || rec_id), rec_id) - 1) % 5 AS BIGINT) AS shard, rows FROM (SELECT rec_id, count(*) AS rows FROM segments GROUP BY rec_id)""")
def q_shard_round_robin(spark, sf):
    return sampling.round_robin_shards(table(spark, sf, "segments"), "rec_id", 5, 2)


@query("""WITH r AS (SELECT source, sample_no, row_number() OVER (PARTITION BY source ORDER BY md5('4|' || sample_no), sample_no) AS rank FROM mcq_samples WHERE source IS NOT NULL),
m AS (SELECT min(n) AS least FROM (SELECT source, count(*) AS n FROM r GROUP BY source)),
o AS (SELECT source, sample_no, rank, row_number() OVER (ORDER BY rank, source) - 1 AS place FROM r, m WHERE rank <= least)
SELECT source, sample_no, CAST(rank AS BIGINT) AS rank, CAST(place AS BIGINT) AS place FROM o WHERE place % 4 = 1""")
def q_sample_interleave(spark, sf):
    rows = sampling.interleave(table(spark, sf, "mcq_samples").select("source", "sample_no"), "source", "sample_no", 4, 1, 4)
    return rows.withColumn("rank", F.col("rank").cast("bigint"))


@query("""SELECT user_id, event_id, round(CASE WHEN count(*) OVER (PARTITION BY user_id) < 5 THEN value ELSE sum(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5 END, 6) AS smoothed FROM events""")
def q_window_moving_average(spark, sf):
    rows = table(spark, sf, "events").select("user_id", "event_id", "value")
    return sampling.moving_average(rows, ["user_id"], "event_id", "value", 5).select("user_id", "event_id", F.round("smoothed", 6).alias("smoothed"))


@query("""WITH m AS (SELECT *, coalesce(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS island FROM events)
SELECT user_id AS run, max(CASE WHEN event_type = 'purchase' THEN event_id END) AS step, round(avg(CASE WHEN event_type != 'purchase' THEN value END), 6) AS mean_before
FROM m GROUP BY user_id, island HAVING max(CASE WHEN event_type = 'purchase' THEN event_id END) IS NOT NULL""")
def q_window_between_saves(spark, sf):
    return sampling.mean_between_events(_logs(spark, sf), ["run"], "step", "loss", F.col("is_save")).select("run", "step", F.round("mean_before", 6).alias("mean_before"))


@query("SELECT utt_id, rec_id, text FROM (SELECT *, row_number() OVER (PARTITION BY utt_id ORDER BY ingested_at DESC) AS r FROM segments) WHERE r = 1")
def q_window_last_wins(spark, sf):
    return sampling.last_wins(table(spark, sf, "segments").select("utt_id", "rec_id", "text", "ingested_at"), ["utt_id"], "ingested_at").select("utt_id", "rec_id", "text")


@query("SELECT DISTINCT o_custkey - 1 AS row FROM orders WHERE o_custkey BETWEEN 1 AND (SELECT max(o_custkey) FROM orders)")
def q_sample_indices(spark, sf):
    orders = table(spark, sf, "orders").select("o_custkey")
    return sampling.normalize_indices(orders, "o_custkey", orders.agg(F.max("o_custkey")).first()[0])


# texts


_W = r"[^\p{L}\p{N}_\s-]"
_COLLAPSE = "trim(regexp_replace({}, '\\s+', ' ', 'g'))"


def _text_labels(rows: DataFrame) -> DataFrame:
    return rows.select("sample_no", tx.normalize_label(F.col("question")).alias("label"), tx.normalize_choice(F.col("gold_choice")).alias("choice"), tx.label_or_null(F.col("language")).alias("language"))


@query("SELECT sample_no, " + _COLLAPSE.format(f"regexp_replace(lower(trim(question)), '{_W}', ' ', 'g')") + " AS label, upper(trim(gold_choice)) AS choice, nullif(lower(trim(language)), '') AS language FROM mcq_samples")
def q_text_labels(spark, sf):
    return _text_labels(table(spark, sf, "mcq_samples"))


@query(r"""SELECT rec_id, regexp_replace(regexp_replace(regexp_replace(trim(audio_path), '[^A-Za-z0-9._-]+', '_', 'g'), '_+', '_', 'g'), '^_+|_+$', '', 'g') AS id, regexp_replace(list_extract(string_split(audio_path, '/'), -1), '\.[^.]*$', '') AS stem,
lower(regexp_extract(audio_path, '([^/_]+)[^/]*/[^/]+$', 1)) AS folder, substr(sha1(audio_path), 1, 12) AS short_hash, sha1(audio_path) AS audio_id FROM recordings""")
def q_text_ids(spark, sf):
    path = F.col("audio_path")
    return table(spark, sf, "recordings").select("rec_id", tx.sanitize_id(path).alias("id"), tx.stem(path).alias("stem"), tx.language_of_path(path).alias("folder"), tx.stable_hash(path).alias("short_hash"), F.sha1(path).alias("audio_id"))


@query(r"SELECT doc_id, length(regexp_replace(coalesce(text, ''), '[^\p{L}]', '', 'g')) AS letters, length(regexp_replace(coalesce(text, ''), '[^\p{L}]', '', 'g')) >= 4 AS translatable FROM documents")
def q_text_letters(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tx.letters(F.col("text")).alias("letters"), tx.is_translatable(F.col("text")).alias("translatable"))


@query("SELECT doc_id, coalesce(nullif(regexp_extract(text, '([ABCD])', 1), ''), '?') AS letter FROM documents")
def q_text_first_letter(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tx.first_option_letter(F.col("text")).alias("letter"))


@query(r"""SELECT sample_no, coalesce(
CASE WHEN list_contains(choice_labels, upper(trim(gold_choice))) THEN upper(trim(gold_choice)) END,
list_extract(list_filter(list_transform(regexp_extract_all(gold_choice, '([A-Za-z0-9_]+)', 1), lambda x: upper(x)), lambda x: list_contains(choice_labels, x)), 1),
list_extract(list_filter(choice_labels, lambda x: length(x) = 1 AND contains(upper(gold_choice), x)), 1)) AS picked FROM mcq_samples""")
def q_text_pick_option(spark, sf):
    return table(spark, sf, "mcq_samples").select("sample_no", tx.pick_option(F.col("gold_choice"), F.col("choice_labels")).alias("picked"))


@query("""SELECT sample_no, 'Pick one label from ' || array_to_string(choice_labels, ', ') || '.' || chr(10) || chr(10) || 'Question: ' || coalesce(question, '') || chr(10) || chr(10)
|| array_to_string(list_transform(choice_labels, lambda x: x || '. ' || coalesce(choices[x], '')), chr(10)) AS prompt FROM mcq_samples""")
def q_text_prompt(spark, sf):
    texts = F.transform("choice_labels", lambda x: F.try_element_at("choices", x))
    return table(spark, sf, "mcq_samples").select("sample_no", tx.prompt(F.col("question"), F.col("choice_labels"), texts).alias("prompt"))


@query(r"""SELECT sample_no, array_to_string(list_transform(string_split_regex(question, '\d+:\d\d'), lambda x, i: CASE WHEN i = 1 THEN x ELSE 'TS' || (i - 2) || 'TS' || x END), '') AS masked, question AS restored FROM mcq_samples""")
def q_text_masked_times(spark, sf):
    masked, found = tx.mask(F.col("question"), r"\d+:\d\d", "TS", "TS")
    rows = table(spark, sf, "mcq_samples").select("sample_no", "question", masked.alias("masked"), found.alias("found"))
    return rows.select("sample_no", "masked", tx.unmask(F.col("masked"), F.col("found"), "TS", "TS").alias("restored"))


@query()
def q_text_loops_cut(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tx.repeated_ngram_cut(F.col("text")).alias("text"))


@query()
def q_text_single_runs(spark, sf):
    return table(spark, sf, "segments").select("utt_id", tx.single_runs_collapsed(F.col("text")).alias("text")).distinct()


# times


_ATOM = rf"(?:{timeref.CLOCK}|{timeref.NUMBER}(?:\s*(?:{timeref.UNITS}))?)"
_SECONDS = r"""CASE WHEN t LIKE '%:%' THEN list_reduce(list_transform(string_split(t, ':'), lambda x: CAST(x AS DOUBLE)), lambda a, x: a * 60 + x)
ELSE CAST(regexp_extract(t, '^([0-9]+(?:\.[0-9]+)?)', 1) AS DOUBLE) * CASE WHEN regexp_matches(t, '[0-9]\s*h') THEN 3600 WHEN regexp_matches(t, '[0-9]\s*m') THEN 60 ELSE 1 END END"""


@query(rf"""WITH q AS (SELECT sample_no, question AS x FROM mcq_samples WHERE question IS NOT NULL),
masked AS (SELECT sample_no, regexp_replace(regexp_replace(regexp_replace(x, '(?i){_ATOM}\s*{timeref.DASH}\s*{_ATOM}', chr(1), 'g'), '(?i){timeref.KEYWORD}\s*{_ATOM}', chr(1), 'g'), '([^\d:])', '\1\1', 'g') AS x FROM q),
pairs AS (
    SELECT sample_no, unnest(regexp_extract_all(x, '(?i)({_ATOM})\s*{timeref.DASH}\s*({_ATOM})', 1)) AS a, unnest(regexp_extract_all(x, '(?i)({_ATOM})\s*{timeref.DASH}\s*({_ATOM})', 2)) AS b FROM q UNION ALL
    SELECT sample_no, unnest(regexp_extract_all(x, '\[\s*({timeref.NUMBER})\s*,\s*({timeref.NUMBER})\s*\]', 1)), unnest(regexp_extract_all(x, '\[\s*({timeref.NUMBER})\s*,\s*({timeref.NUMBER})\s*\]', 2)) FROM q UNION ALL
    SELECT sample_no, t, t FROM (SELECT sample_no, unnest(regexp_extract_all(x, '(?i){timeref.KEYWORD}\s*({_ATOM})', 1)) AS t FROM q) UNION ALL
    SELECT sample_no, t, t FROM (SELECT sample_no, unnest(regexp_extract_all(x, '(?:^|[^\d:])({timeref.CLOCK})(?:[^\d:]|$)', 1)) AS t FROM masked)
), timed AS (
    SELECT sample_no, (SELECT {_SECONDS} FROM (SELECT replace(lower(trim(a)), ',', '.') AS t)) AS a, (SELECT {_SECONDS} FROM (SELECT replace(lower(trim(b)), ',', '.') AS t)) AS b FROM pairs
), turned AS (SELECT DISTINCT sample_no, least(a, b) AS lo, greatest(a, b) AS hi FROM timed)
SELECT sample_no, row_number() OVER (PARTITION BY sample_no ORDER BY lo, hi) - 1 AS place, lo, hi FROM turned""")
def q_time_ranges(spark, sf):
    found = table(spark, sf, "mcq_samples").select("sample_no", F.posexplode(timeref.time_ranges(F.col("question"))).alias("place", "r"))
    return found.select("sample_no", F.col("place").cast("bigint").alias("place"), F.col("r.lo").alias("lo"), F.col("r.hi").alias("hi"))


@query("""SELECT rec_id, CAST(i AS INT) AS chunk, i * 58.0 AS lo, least(i * 58.0 + 60.0, duration_sec) AS hi FROM (
SELECT rec_id, duration_sec, unnest(generate_series(0, CAST(greatest(ceil((duration_sec - 2.0) / 58.0), 1) AS BIGINT) - 1)) AS i FROM recordings WHERE duration_sec > 0)""")
def q_time_chunks(spark, sf):
    rows = table(spark, sf, "recordings").where("duration_sec > 0")
    made = rows.select("rec_id", F.posexplode(timeref.chunks(F.col("duration_sec"), 60.0, 2.0)).alias("chunk", "c"))
    return made.select("rec_id", "chunk", F.col("c.lo").alias("lo"), F.col("c.hi").alias("hi"))


@query("SELECT rec_id, CAST(round(duration_sec * 100) AS BIGINT) AS cs FROM recordings")
def q_time_centiseconds(spark, sf):
    return table(spark, sf, "recordings").select("rec_id", intervals.centiseconds(F.col("duration_sec")).alias("cs"))


@query("SELECT rec_id, CAST(round_even(duration_sec * 100, 0) AS BIGINT) AS cs FROM recordings")
def q_time_half_even(spark, sf):
    return table(spark, sf, "recordings").select("rec_id", intervals.half_even_centiseconds(F.col("duration_sec")).alias("cs"))


# questions and calibration


def _options(spark, sf):
    rows = table(spark, sf, "mcq_samples").select("sample_no", F.upper(F.trim("gold_choice")).alias("gold"), mcq.options_in_order(F.col("choice_labels"), F.col("choices")).alias("options"))
    return rows


@query("""WITH q AS (SELECT sample_no, upper(trim(gold_choice)) AS gold, choice_labels AS l, list_position(choice_labels, upper(trim(gold_choice))) AS pos FROM mcq_samples),
v AS (SELECT sample_no, gold, l, pos, 0 AS variant, 0 AS place FROM q UNION ALL
SELECT sample_no, gold, l, pos, CASE WHEN p < pos THEN p ELSE p - 1 END, p FROM (SELECT *, unnest(generate_series(1, len(l))) AS p FROM q WHERE pos > 0) WHERE p != pos)
SELECT sample_no, CAST(variant AS INT) AS variant, gold, array_to_string(list_transform(l, lambda x, i: CASE WHEN variant > 0 AND i = pos THEN l[place] WHEN variant > 0 AND i = place THEN l[pos] ELSE x END), ' ') AS labels FROM v""")
def q_mcq_swap_variants(spark, sf):
    rows = mcq.swap_variants(_options(spark, sf), "options", "gold")
    return rows.select("sample_no", "variant", "gold", F.array_join(F.transform("options", lambda o: o["label"]), " ").alias("labels"))


@query("""SELECT sample_no, array_to_string(list_transform(choice_labels, lambda x: coalesce(choices[CASE WHEN list_contains(choice_labels, g) AND x = g THEN 'B' WHEN list_contains(choice_labels, g) AND x = 'B' THEN g ELSE x END], '')), '|') AS texts
FROM (SELECT *, upper(trim(gold_choice)) AS g FROM mcq_samples)""")
def q_mcq_target_b(spark, sf):
    rows = _options(spark, sf)
    moved = mcq.target_variant(F.col("options"), F.col("gold"), F.lit("B"))
    return rows.select("sample_no", F.array_join(F.transform(moved, lambda o: F.coalesce(o["text"], F.lit(""))), "|").alias("texts"))


@query("""SELECT sample_no, CAST(r AS INT) AS rotation, array_to_string(list_transform(choice_labels, lambda x, i: choice_labels[(i - 1 + r) % len(choice_labels) + 1]), '') AS shown
FROM (SELECT sample_no, choice_labels, unnest(generate_series(0, len(choice_labels) - 1)) AS r FROM mcq_samples)""")
def q_mcq_rotations(spark, sf):
    rows = mcq.rotations(table(spark, sf, "mcq_samples").select("sample_no", "choice_labels"), "choice_labels")
    return rows.select("sample_no", "rotation", F.array_join("shown", "").alias("shown"))


def _probs(spark, sf):
    # four scores of all entries: every fourth one's sum
    entries = F.transform("embedding", lambda x: x.cast("double"))
    every_fourth = lambda k: F.filter(entries, lambda _, i: i % 4 == k)
    four = F.array(*(F.round(F.aggregate(every_fourth(k), F.lit(0.0), lambda a, x: a + x), 9) for k in range(4)))
    return table(spark, sf, "embeddings").select("vec_id", (F.col("label") % 4).cast("int").alias("gold"), mcq.softmax(four).alias("probs"))


_PROBS = """WITH s AS (SELECT vec_id, label % 4 AS gold, list_transform([0, 1, 2, 3], lambda k: round(list_sum(list_transform(list_filter(range(len(embedding)), lambda i: i % 4 = k), lambda i: CAST(embedding[i + 1] AS DOUBLE))), 9)) AS e FROM embeddings),
p AS (SELECT vec_id, gold, list_transform(e, lambda x: exp(x - list_max(e)) / list_sum(list_transform(e, lambda y: exp(y - list_max(e))))) AS probs FROM s)
"""


@query(_PROBS + "SELECT vec_id, CAST(list_position(probs, list_max(probs)) - 1 AS INT) AS choice, round(list_sort(probs, 'DESC')[1] - list_sort(probs, 'DESC')[2], 6) AS margin FROM p")
def q_mcq_margin(spark, sf):
    return _probs(spark, sf).select("vec_id", mcq.argmax(F.col("probs")).alias("choice"), F.round(mcq.margin(F.col("probs")), 6).alias("margin"))


@query(_PROBS + "SELECT CAST(i AS INT) AS place, round(avg(probs[i + 1]), 6) AS prior FROM p, (SELECT unnest(generate_series(0, 3)) AS i) GROUP BY i")
def q_mcq_class_prior(spark, sf):
    return mcq.class_prior(_probs(spark, sf), "probs", 4).select("place", F.round("prior", 6).alias("prior"))


_ALPHAS = [0.0, 0.5, 1.0, 1.5, 2.0]


@query(_PROBS + """, a AS (SELECT unnest([0.0, 0.5, 1.0, 1.5, 2.0]) AS alpha),
c AS (SELECT alpha, gold, list_transform(probs, lambda x, i: round(ln(greatest(x, 1e-9)) - alpha * ln([0.4, 0.3, 0.2, 0.1][i]), 9)) AS z FROM p, a)
SELECT CAST(alpha AS DOUBLE) AS alpha, count(*) AS n, round(avg(CASE WHEN list_position(z, list_max(z)) - 1 = gold THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM c GROUP BY alpha""")
def q_mcq_calibration_sweep(spark, sf):
    return mcq.calibration_sweep(_probs(spark, sf), "probs", "gold", [0.4, 0.3, 0.2, 0.1], _ALPHAS)


@query(_PROBS + """, slots AS (SELECT vec_id, r, j, probs[CAST((j * 3 + r) % 4 AS INT) + 1] AS p FROM p, (SELECT unnest([0, 1, 2, 3]) AS r), (SELECT unnest([0, 1, 2, 3]) AS j)),
best AS (SELECT vec_id, r, (arg_min(j, struct_pack(a := -p, b := j)) + r) % 4 AS content FROM slots GROUP BY vec_id, r),
agreed AS (SELECT vec_id, count(*) AS rotations, count(DISTINCT content) = 1 AS consistent FROM best GROUP BY vec_id),
means AS (SELECT vec_id, (j + r) % 4 AS content, round(sum(p / 4), 9) AS prob FROM slots GROUP BY vec_id, (j + r) % 4),
chosen AS (SELECT vec_id, CAST(arg_min(content, struct_pack(a := -prob, b := content)) AS INT) AS chosen FROM means GROUP BY vec_id)
SELECT vec_id, rotations, consistent, chosen FROM agreed JOIN chosen USING (vec_id)""")
def q_mcq_rotation_summary(spark, sf):
    turned = _probs(spark, sf).withColumn("rotation", F.explode(F.sequence(F.lit(0), F.lit(3))))
    slots = F.transform("probs", lambda _, j: F.get(F.col("probs"), ((j * 3 + F.col("rotation")) % 4).cast("int")))
    return mcq.rotation_summary(turned.select("vec_id", "rotation", slots.alias("slots")), ["vec_id"], "rotation", "slots")


# errors of words and characters


def _scored(spark, sf):
    """Each segment's text against itself without every fourth word."""
    words = F.filter(F.split(F.trim("text"), " "), lambda w: w != "")
    rows = table(spark, sf, "segments").where("trim(text) != ''").select("utt_id", "language", F.array_join(words, " ").alias("reference"), F.array_join(F.filter(words, lambda _, i: i % 4 != 3), " ").alias("hypothesis"))
    return rows.distinct()


@query("""WITH s AS (SELECT DISTINCT utt_id, language, list_filter(string_split(trim(text), ' '), lambda w: w != '') AS w FROM segments WHERE trim(text) != '')
SELECT language, CAST(sum(len(w) // 4) AS BIGINT) AS edits, CAST(sum(len(w)) AS BIGINT) AS units, round(CAST(sum(len(w) // 4) AS DOUBLE) / sum(len(w)), 6) AS rate FROM s WHERE language IS NOT NULL GROUP BY 1""")
def q_metric_wer_by_language(spark, sf):
    rows = metrics.with_word_errors(_scored(spark, sf), "reference", "hypothesis")
    return metrics.error_rate(rows.where("language is not null"), "word_edits", "words", ["language"])


#: Where words are only left out, the edits are the letters and spaces that are missing, and the alignment has hits and deletions alone.
_LEFT_OUT = """WITH w AS (SELECT DISTINCT utt_id, language, list_filter(string_split(trim(text), ' '), lambda w: w != '') AS w FROM segments WHERE trim(text) != ''),
s AS (SELECT utt_id, language, w, length(array_to_string(w, ' ')) AS n, length(array_to_string(list_filter(w, lambda x, i: i % 4 != 0), ' ')) AS m FROM w)
"""


@query(_LEFT_OUT + "SELECT language, CAST(sum(n - m) AS BIGINT) AS edits, CAST(sum(n) AS BIGINT) AS units, round(CAST(sum(n - m) AS DOUBLE) / sum(n), 6) AS rate FROM s WHERE language IS NOT NULL GROUP BY language")
def q_metric_cer_by_language(spark, sf):
    rows = metrics.with_character_errors(_scored(spark, sf), "reference", "hypothesis")
    return metrics.error_rate(rows.where("language is not null"), "character_edits", "characters", ["language"])


@query(_LEFT_OUT + "SELECT CAST(sum(len(w) - len(w) // 4) AS BIGINT) AS hits, CAST(0 AS BIGINT) AS substitutions, CAST(sum(len(w) // 4) AS BIGINT) AS deletions, CAST(0 AS BIGINT) AS insertions FROM s")
def q_metric_alignment(spark, sf):
    rows = metrics.alignment_counts(_scored(spark, sf), ["utt_id"], "reference", "hypothesis")
    return rows.agg(*(F.sum(c).alias(c) for c in ("hits", "substitutions", "deletions", "insertions")))


# counts, sets and orders of the question table


@query("SELECT split, count(*) AS rows, count(DISTINCT audio_path) AS audio, count(DISTINCT nullif(lower(trim(language)), '')) AS languages FROM mcq_samples GROUP BY split")
def q_agg_distinct_counts(spark, sf):
    return table(spark, sf, "mcq_samples").groupBy("split").agg(F.count("*").alias("rows"), F.count_distinct("audio_path").alias("audio"), F.count_distinct(tx.label_or_null(F.col("language"))).alias("languages"))


@query("SELECT audio_path, sha1(audio_path) AS audio_id, count(*) AS questions FROM mcq_samples WHERE audio_path IS NOT NULL GROUP BY audio_path")
def q_agg_questions_per_audio(spark, sf):
    rows = table(spark, sf, "mcq_samples").where("audio_path is not null")
    return rows.groupBy("audio_path").agg(F.sha1("audio_path").alias("audio_id"), F.count("*").alias("questions"))


@query("SELECT label, count(*) AS questions, min(sample_no) AS first_no FROM (SELECT sample_no, unnest(choice_labels) AS label FROM mcq_samples) GROUP BY label")
def q_agg_label_availability(spark, sf):
    each = table(spark, sf, "mcq_samples").select("sample_no", F.explode("choice_labels").alias("label"))
    return each.groupBy("label").agg(F.count("*").alias("questions"), F.min("sample_no").alias("first_no"))


@query("SELECT count(sample_id) AS rows, count(DISTINCT sample_id) AS different, count(sample_id) > count(DISTINCT sample_id) AS repeated FROM mcq_samples")
def q_set_duplicates(spark, sf):
    n, d = F.count("sample_id"), F.count_distinct("sample_id")
    return table(spark, sf, "mcq_samples").agg(n.alias("rows"), d.alias("different"), (n > d).alias("repeated"))


@query("""SELECT sample_no, question, prompt_text, 'original' AS version FROM mcq_samples UNION ALL
SELECT sample_no, prompt_text, question, 'translated' FROM mcq_samples WHERE lower(trim(language)) NOT LIKE 'en%'""")
def q_set_mixed_union(spark, sf):
    """The copies that stand for translations have question and prompt exchanged."""
    rows = table(spark, sf, "mcq_samples").select("sample_no", "question", "prompt_text", "language")
    copies = rows.select("sample_no", F.col("prompt_text").alias("question"), F.col("question").alias("prompt_text"), "language")
    return corpora.mixed(rows, copies, "language").drop("language")


@query("""SELECT language, utt_id FROM (SELECT language, utt_id, row_number() OVER (PARTITION BY language ORDER BY md5('9|' || utt_id), utt_id, ingested_at) AS r FROM segments)
WHERE r <= CASE WHEN language = 'english' THEN 60 ELSE 25 END""")
def q_sample_capped_languages(spark, sf):
    rows = table(spark, sf, "segments").select("language", "utt_id", "ingested_at")
    ranked = sampling.group_rank(rows, ["language"], [sampling.hash_key(F.col("utt_id"), 9), F.col("utt_id"), F.col("ingested_at")], "r")
    cap = F.when(F.col("language") == "english", 60).otherwise(25)
    return ranked.where(F.col("r") <= cap).select("language", "utt_id")


@query(_PREDS + "SELECT source, sample_no, round(avg(CASE WHEN is_correct THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY source ORDER BY sample_no ROWS UNBOUNDED PRECEDING), 6) AS running FROM preds")
def q_window_running_accuracy(spark, sf):
    rows = sampling.running_mean(_predictions(spark, sf), ["source"], ["sample_no"], F.when(F.col("is_correct"), 1.0).otherwise(0.0))
    return rows.select("source", "sample_no", F.round("running", 6).alias("running"))


@query("""WITH s AS (SELECT DISTINCT utt_id, list_filter(string_split(trim(text), ' '), lambda w: w != '') AS w FROM segments WHERE trim(text) != '')
SELECT utt_id, CAST(len(w) // 4 AS BIGINT) AS word_edits, CAST(len(w) AS BIGINT) AS words FROM s ORDER BY word_edits DESC, words DESC, utt_id LIMIT 50""")
def q_sort_worst_sentences(spark, sf):
    rows = metrics.with_word_errors(_scored(spark, sf).drop("language").distinct(), "reference", "hypothesis")
    return rows.orderBy(F.desc("word_edits"), F.desc("words"), "utt_id").limit(50).select("utt_id", "word_edits", "words")


_NORMAL = r"trim(regexp_replace(regexp_replace(lower(trim({})), '[^\p{{L}}\p{{N}}_\s-]', ' ', 'g'), '\s+', ' ', 'g'))"


@query(f"""SELECT sample_no, CASE WHEN list_contains(choice_labels, upper(trim(gold_choice))) THEN upper(trim(gold_choice)) ELSE
list_extract(list_filter(choice_labels, lambda x: {_NORMAL.format('choices[x]')} = {_NORMAL.format('gold_choice')}), 1) END AS gold FROM mcq_samples""")
def q_text_resolve_gold(spark, sf):
    texts = F.transform("choice_labels", lambda x: F.try_element_at("choices", x))
    return table(spark, sf, "mcq_samples").select("sample_no", tx.resolve_gold(F.col("choice_labels"), texts, F.col("gold_choice")).alias("gold"))
