"""Further queries of the speech and question operators over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from speechloom.functions import ids, phrases, timeref
from speechloom.functions import text as tx
from speechloom.operators import batches, corpora, ingest, joins, mcq, metrics, nested, sampling, selection, signal, validity
from speechloom.plans import pipelines
from speechloom.plans.reference import _PREDS, _PROBS, _predictions, _probs, _scored, query
from speechloom.sources import files
from speechloom.sources.tables import table

# ids and paths

_CLEAN = "regexp_replace(regexp_replace(regexp_replace(trim(coalesce({0}, '')), '[/()]', '_', 'g'), '_{{2,}}', '_', 'g'), '^_+|_+$', '', 'g')"


@query(f"""SELECT sample_no, {_CLEAN.format('audio_path')} AS session, CASE WHEN len(p) >= 2 AND p[-2] != '' THEN p[-2] || '_' || regexp_replace(p[-1], '(.)\\.[^.]*$', '\\1') ELSE regexp_replace(p[-1], '(.)\\.[^.]*$', '\\1') END AS accent_stem,
split_part(sample_id, '__', 1) AS lead FROM (SELECT *, string_split(replace(audio_path, '\\', '/'), '/') AS p FROM mcq_samples)""")
def q_ids_of_paths(spark, sf):
    path = F.col("audio_path")
    return table(spark, sf, "mcq_samples").select("sample_no", ids.session_id(path).alias("session"), ids.accent_and_stem(path).alias("accent_stem"), ids.language_of_utterance(F.col("sample_id")).alias("lead"))


@query(f"""WITH f AS (SELECT rec_id, audio_path, list_filter(string_split(audio_path, '/'), lambda x: x != '') AS p FROM recordings),
g AS (SELECT *, p[:len(p) - 1] AS folders, len(p) - list_position(list_reverse(p), 'data') + 1 AS pos FROM f),
h AS (SELECT *, CASE WHEN list_contains(p, 'data') AND pos < len(p) - 1 THEN p[pos + 1:len(p) - 1] ELSE folders END AS c, regexp_replace(p[-1], '\\.[^.]*$', '') AS stem FROM g)
SELECT rec_id, CASE WHEN c[-1] IS NULL THEN stem WHEN c[-2] = 'English' AND c[-1] IN ('American', 'Australian', 'British', 'Filipino', 'Indian') THEN 'English_' || c[-1] || '_' || stem ELSE {_CLEAN.format('c[-1]')} || '_' || stem END AS session FROM h""")
def q_ids_session_of_path(spark, sf):
    """Folders named by language and country lose their brackets as any other does."""
    return table(spark, sf, "recordings").select("rec_id", ids.session_of_path(F.col("audio_path")).alias("session"))


@query("""WITH s AS (SELECT rec_id, string_split(regexp_replace(rec_id, '_{2,}', '_', 'g'), '_') AS p FROM recordings)
SELECT rec_id, array_to_string(CASE WHEN p[1] = 'English' AND p[2] IN ('American', 'Australian', 'British', 'Filipino', 'Indian') THEN [p[1] || '/' || p[2] || '/' || array_to_string(p[3:], '_') || '.wav']
WHEN p[1] || '_' || p[2] IN ('French_Canada', 'Portuguese_Brazil', 'Spanish_Mexico') THEN [p[1] || '(' || p[2] || ')/' || array_to_string(p[3:], '_') || '.wav', p[1] || '_' || p[2] || '/' || array_to_string(p[3:], '_') || '.wav']
ELSE [p[1] || '/' || array_to_string(p[2:], '_') || '.wav'] END, ' ') AS paths FROM s""")
def q_ids_paths_of_session(spark, sf):
    return table(spark, sf, "recordings").select("rec_id", F.array_join(ids.paths_of_session(F.col("rec_id")), " ").alias("paths"))


@query("""SELECT rec_id, CASE WHEN audio_path LIKE '/%' THEN audio_path ELSE '/corpus/' || audio_path END AS first, CASE WHEN audio_path LIKE '/%' THEN 1 ELSE 2 END AS n FROM recordings""")
def q_ids_candidates(spark, sf):
    found = ids.resolved_candidates(F.col("audio_path"), "/corpus", "no-such-folder")
    return table(spark, sf, "recordings").select("rec_id", F.get(found, F.lit(0)).alias("first"), F.size(found).alias("n"))


# texts


@query(r"""SELECT utt_id, text, lower(trim(regexp_replace(regexp_replace(speaker, '_', ' ', 'g'), '\s+', ' ', 'g'))) AS speaker, language AS raw, CASE lower(trim(language)) WHEN 'english' THEN 'en' WHEN 'french' THEN 'fr' WHEN 'german' THEN 'de' WHEN 'italian' THEN 'it' WHEN 'japanese' THEN 'ja' WHEN 'korean' THEN 'ko'
WHEN 'portuguese' THEN 'pt' WHEN 'russian' THEN 'ru' WHEN 'spanish' THEN 'es' WHEN 'french(canada)' THEN 'fr' WHEN 'portuguese(brazil)' THEN 'pt' WHEN 'spanish(mexico)' THEN 'es' WHEN 'tagalog' THEN 'tl' WHEN 'thai' THEN 'th' WHEN 'turkish' THEN 'tr' WHEN 'urdu' THEN 'ur' WHEN 'vietnamese' THEN 'vi' ELSE lower(trim(language)) END AS code FROM segments""")
def q_text_codes(spark, sf):
    return table(spark, sf, "segments").select("utt_id", "text", tx.normalize_token(F.col("speaker")).alias("speaker"), F.col("language").alias("raw"), tx.language_code(F.col("language")).alias("code"))


@query(r"""SELECT rec_id, lower(trim(regexp_replace(replace(p[1], '_', ' '), '\s+', ' ', 'g'))) || ' (' || lower(trim(regexp_replace(replace(p[2], '_', ' '), '\s+', ' ', 'g'))) || ')' AS label FROM (SELECT rec_id, string_split(rec_id, '__') AS p FROM recordings)""")
def q_text_language_labels(spark, sf):
    parts = F.split("rec_id", "__")
    return table(spark, sf, "recordings").select("rec_id", tx.language_label(parts[0], parts[1]).alias("label"))


@query(r"""WITH f AS (SELECT DISTINCT utt_id, language, lower(trim(language)) IN ('japanese', 'korean', 'thai', 'ja', 'ko', 'th', 'zh', 'zh-cn', 'zh-tw', 'yue') AS single, regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}_\s]', ' ', 'g') AS t FROM segments)
SELECT DISTINCT utt_id, trim(regexp_replace(CASE WHEN coalesce(single, false) THEN trim(regexp_replace(regexp_replace(t, '\s+', '', 'g'), '(.)', '\1 ', 'g')) ELSE t END, '\s+', ' ', 'g')) AS form FROM f""")
def q_text_scoring_form(spark, sf):
    return table(spark, sf, "segments").select("utt_id", tx.for_scoring(F.col("text"), F.col("language")).alias("form")).distinct()


@query()
def q_text_scoring_spoken(spark, sf):
    """Without SQL: word boundaries of any script are looked around for."""
    return table(spark, sf, "segments").select("utt_id", tx.for_scoring_spoken(F.col("text"), F.col("language")).alias("form")).distinct()


@query()
def q_text_number_words(spark, sf):
    """Without SQL: compared with a loop over all numbers in the tests."""
    return table(spark, sf, "orders").select("o_orderkey", tx.in_words(F.col("o_orderkey")).alias("words"))


@query()
def q_text_nearest_label(spark, sf):
    """Without SQL: similarity by matching blocks."""
    return table(spark, sf, "mcq_samples").select("sample_no", phrases.nearest_label(F.col("gold_choice"), F.map_values("choices")).alias("label"))


@query(r"""WITH t AS (SELECT trim(regexp_replace(lower(trim(coalesce(text, ''))), '\s+', ' ', 'g')) AS t FROM segments), w AS (SELECT t, regexp_extract_all(t, '[\p{L}\p{N}_]+') AS w FROM t WHERE t != ''),
g AS (SELECT t AS phrase FROM w UNION ALL SELECT array_to_string(w[i:i + k - 1], ' ') FROM (SELECT w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM w, (SELECT unnest([2, 3, 4, 5, 6]) AS k) WHERE len(w) >= k))
SELECT phrase, count(*) AS n FROM g WHERE length(phrase) >= 6 GROUP BY phrase HAVING count(*) >= 2""")
def q_text_mined_phrases(spark, sf):
    return phrases.mined_phrases(table(spark, sf, "segments"), "text")


@query()
def q_text_without_hallucinations(spark, sf):
    """Without SQL: back-references and a search that restarts."""
    known = spark.sparkContext.broadcast(["at the end of the month", "on thursday evening"])
    return table(spark, sf, "segments").select("utt_id", phrases.without_hallucinations(F.col("text"), known).alias("text")).distinct()


@query()
def q_text_usable_transcript(spark, sf):
    """Without SQL: loops are looked for window by window."""
    return table(spark, sf, "documents").select("doc_id", phrases.usable_transcript(F.col("text"), 200).alias("text"))


_TS = r"(?:\d{1,2}:\d{2}(?::\d{2})?(?:\.\d+)?|\d{1,4}(?:\.\d+)?)"
_LEAD = r"(?i)^(?:listen to|compare|based on|according to|in the segment|in this segment) "


@query(rf"""WITH r AS (SELECT sample_no, trim(regexp_replace(coalesce(question, ''), '\s+', ' ', 'g')) AS raw FROM mcq_samples),
s AS (SELECT *, CASE WHEN regexp_matches(raw, '{_LEAD}') THEN regexp_replace(regexp_replace(raw, '{_LEAD}', ''), '^[ ,.\-]+|[ ,.\-]+$', '', 'g') ELSE raw END AS s FROM r),
c AS (SELECT *, trim(regexp_replace(trim(regexp_replace(s, '\?+$', '')), '^\s*{_TS}\s*(?:-|to|~|–|—)\s*{_TS}\s*[,.:;\-]?\s*', '')) AS core, regexp_extract_all(raw, '({_TS})\s*(?:-|to|~|–|—)\s*({_TS})', 1) AS a, regexp_extract_all(raw, '({_TS})\s*(?:-|to|~|–|—)\s*({_TS})', 2) AS b FROM s),
k AS (SELECT *, CASE WHEN regexp_matches(core, '^(?:What|Which|How|Why|Who|Where|When) ') THEN lower(core[1]) || core[2:] ELSE core END AS low,
CASE WHEN raw = '' THEN 'empty' WHEN len(a) >= 2 THEN 'compare_multi_range' WHEN len(a) = 1 THEN 'listen_single_range' WHEN lower(raw) LIKE 'according to%' THEN 'according_no_range' WHEN lower(raw) LIKE 'based on%' THEN 'based_no_range' ELSE 'generic_eval_style' END AS kind FROM c),
t AS (SELECT sample_no, kind, trim(CASE kind WHEN 'empty' THEN '' WHEN 'compare_multi_range' THEN 'Compare the audio evidence between [' || a[1] || ', ' || b[1] || '] and [' || a[2] || ', ' || b[2] || ']. ' || core
WHEN 'listen_single_range' THEN 'Listen to the segment [' || a[1] || ', ' || b[1] || ']. ' || core WHEN 'according_no_range' THEN 'According to the conversation, ' || low ELSE 'Based on the conversation, ' || low END) AS text FROM k)
SELECT sample_no, kind, CASE WHEN kind = 'empty' OR text LIKE '%?' THEN text ELSE text || '?' END AS text FROM t""")
def q_text_rephrased(spark, sf):
    made = table(spark, sf, "mcq_samples").select("sample_no", phrases.rephrased(F.col("question")).alias("r"))
    return made.select("sample_no", "r.kind", "r.text")


@query(r"SELECT utt_id, array_to_string(regexp_extract_all(text, '(\"[^\"]*\"|«[^»]*»|“[^”]*”|[^\"«“]+|[\"«“])', 1), '|') AS runs FROM (SELECT DISTINCT utt_id, text FROM segments)")
def q_text_quoted_runs(spark, sf):
    return table(spark, sf, "segments").select("utt_id", "text").distinct().select("utt_id", F.array_join(tx.quoted_runs(F.col("text")), "|").alias("runs"))


@query(r"SELECT utt_id, trim(regexp_replace(regexp_replace(text, '([\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{AC00}-\x{D7AF}\x{0E00}-\x{0E7F}])', ' \1 ', 'g'), '\s+', ' ', 'g')) AS spaced FROM (SELECT DISTINCT utt_id, text FROM segments)")
def q_text_spaced(spark, sf):
    return table(spark, sf, "segments").select("utt_id", "text").distinct().select("utt_id", tx.space_characters(F.col("text")).alias("spaced"))


@query("SELECT DISTINCT utt_id, trim(text) = text AS same, trim(text) = trim(lower(text)) AS same_lower FROM segments WHERE text IS NOT NULL")
def q_text_exact_flags(spark, sf):
    t = F.col("text")
    return table(spark, sf, "segments").where(t.isNotNull()).select("utt_id", (F.trim(t) == t).alias("same"), (F.trim(t) == F.trim(F.lower(t))).alias("same_lower")).distinct()


@query("SELECT source, count(*) AS n, substr(sha1(source || '|' || count(*)), 1, 12) AS key FROM documents GROUP BY source")
def q_text_stable_keys(spark, sf):
    counts = table(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("n"))
    return counts.select("source", "n", tx.stable_hash(F.concat_ws("|", "source", "n")).alias("key"))


# times


def _tokens(spark, sf):
    """Durations in five forms of tokens."""
    d, k = F.col("duration_sec"), F.pmod(F.length("rec_id"), F.lit(5))
    whole = F.floor(d).cast("bigint")
    token = F.when(k == 0, F.concat(whole, F.lit("s"))).when(k == 1, F.concat(whole, F.lit(",5"))).when(k == 2, F.concat(F.floor(whole / 60), F.lit(":"), whole % 60)).when(k == 3, F.concat(whole, F.lit(" min"))).otherwise(F.concat(F.lit("1:"), whole % 60, F.lit(":"), whole % 7))
    return table(spark, sf, "recordings").where("duration_sec is not null").select("rec_id", "duration_sec", token.alias("token"))


_TOKENS = """WITH t AS (SELECT rec_id, duration_sec AS d, CAST(floor(duration_sec) AS BIGINT) AS w, length(rec_id) % 5 AS k FROM recordings WHERE duration_sec IS NOT NULL),
u AS (SELECT *, CASE k WHEN 0 THEN w || 's' WHEN 1 THEN w || ',5' WHEN 2 THEN (w // 60) || ':' || (w % 60) WHEN 3 THEN w || ' min' ELSE '1:' || (w % 60) || ':' || (w % 7) END AS token FROM t)
"""


@query(_TOKENS + """SELECT rec_id, token, CAST(CASE k WHEN 1 THEN w + 0.5 WHEN 3 THEN w * 60 WHEN 4 THEN 3600 + w % 60 * 60 + w % 7 ELSE w END AS DOUBLE) AS seconds,
CASE k WHEN 0 THEN CAST(round_even(d, 0) AS BIGINT) || 's' WHEN 1 THEN printf('%.2f', round_even(d, 2)) || 's' WHEN 3 THEN CAST(round_even(d / 60, 0) AS BIGINT) || 'min'
ELSE CASE WHEN k = 4 OR d >= 3600 THEN printf('%02d:', CAST(round_even(d, 0) AS BIGINT) // 3600) || printf('%02d:%02d', CAST(round_even(d, 0) AS BIGINT) % 3600 // 60, CAST(round_even(d, 0) AS BIGINT) % 60)
ELSE printf('%02d:%02d', CAST(round_even(d, 0) AS BIGINT) // 60, CAST(round_even(d, 0) AS BIGINT) % 60) END END AS shown FROM u""")
def q_time_tokens(spark, sf):
    t = F.col("token")
    return _tokens(spark, sf).select("rec_id", "token", timeref.seconds_of(t).alias("seconds"), timeref.like_token(F.col("duration_sec"), t).alias("shown"))


def _cropped(spark, sf):
    return pipelines.cropped_questions(table(spark, sf, "mcq_samples").select("sample_no", "question", F.lit(600.0).alias("duration")), "question", "duration", 5.0)


@query()
def q_time_rewritten(spark, sf):
    """Without SQL: three passes over the text, each over the result of the one before."""
    return _cropped(spark, sf).select("sample_no", "question", F.size("windows").alias("windows"))


@query("""WITH w AS (SELECT rec_id, greatest(duration_sec / 4 - 30, 0) AS a, least(duration_sec / 4 + 30, duration_sec) AS b, greatest(duration_sec / 2 - 30, 0) AS c, least(duration_sec / 2 + 30, duration_sec) AS e, duration_sec / 2 AS t FROM recordings WHERE duration_sec > 0)
SELECT rec_id, round(CASE WHEN t BETWEEN a AND b THEN t - a WHEN t BETWEEN c AND e THEN b - a + t - c END, 6) AS local FROM w WHERE b > a AND e > c""")
def q_time_local(spark, sf):
    d = F.col("duration_sec")
    points = F.array(*(F.struct((d / k).alias("lo"), (d / k).alias("hi")) for k in (4, 2)))
    rows = table(spark, sf, "recordings").where("duration_sec > 0").select("rec_id", "duration_sec", timeref.crop_windows(points, d, 30.0).alias("w"))
    return rows.select("rec_id", F.round(timeref.local_time(d / 2, F.col("w")), 6).alias("local"))


@query("""SELECT s.utt_id, s.rec_id, CASE WHEN s.end_sec < 0 THEN 0 ELSE greatest(least(CAST(round_even(s.start_sec * r.sampling_rate, 0) AS BIGINT), CAST(round_even(r.duration_sec * r.sampling_rate, 0) AS BIGINT)), 0) END AS lo,
CASE WHEN s.end_sec < 0 THEN CAST(round_even(r.duration_sec * r.sampling_rate, 0) AS BIGINT) ELSE greatest(least(CAST(round_even(s.end_sec * r.sampling_rate, 0) AS BIGINT), CAST(round_even(r.duration_sec * r.sampling_rate, 0) AS BIGINT)), 0) END AS hi
FROM segments s JOIN recordings r ON s.rec_id = r.rec_id WHERE r.sampling_rate > 0 AND r.duration_sec IS NOT NULL AND isfinite(s.start_sec) AND isfinite(s.end_sec) AND abs(s.start_sec) < 1e9 AND abs(s.end_sec) < 1e9 AND hi > lo AND (hi - lo) / r.sampling_rate >= 0.1""")
def q_valid_clips(spark, sf):
    return validity.usable_clips(table(spark, sf, "segments").where("abs(start_sec) < 1e9 and abs(end_sec) < 1e9"), table(spark, sf, "recordings"))


# validity

_AUDIO = """WITH a AS (SELECT vec_id, CASE WHEN vec_id % 11 = 0 THEN NULL WHEN vec_id % 13 = 0 THEN [] WHEN vec_id % 17 = 0 THEN list_transform(embedding, lambda x: CAST(0 AS FLOAT)) ELSE embedding END AS x, CASE WHEN vec_id % 7 = 0 THEN 0 WHEN vec_id % 5 = 0 THEN 100000 ELSE 16 END AS rate, CASE WHEN vec_id % 3 = 0 THEN ' ' ELSE 'text' END AS text FROM embeddings)
"""


@query(_AUDIO + """SELECT vec_id, array_to_string(list_sort(list_filter([CASE WHEN text = ' ' THEN 'empty_text' END, CASE WHEN x IS NULL THEN 'missing_audio' END, CASE WHEN len(x) = 0 THEN 'empty_audio' END, CASE WHEN len(x) > 0 AND rate <= 0 THEN 'invalid_sample_rate' END,
CASE WHEN len(x) > 0 AND rate > 0 AND len(x) / rate < 0.1 THEN 'too_short_<100ms' END, CASE WHEN len(x) > 0 AND rate > 0 AND list_max(list_transform(x, lambda v: abs(v))) = 0 THEN 'digital_zero_wave' END], lambda r: r IS NOT NULL)), '|') AS reasons FROM a""")
def q_valid_audio(spark, sf):
    k, x = F.col("vec_id"), F.col("embedding")
    samples = F.when(k % 11 == 0, None).when(k % 13 == 0, F.array().cast("array<float>")).when(k % 17 == 0, signal.zeroed(x)).otherwise(x)
    rate = F.when(k % 7 == 0, 0).when(k % 5 == 0, 100_000).otherwise(16)
    return table(spark, sf, "embeddings").select("vec_id", validity.audio_reasons(samples, rate, F.when(k % 3 == 0, " ").otherwise("text")).alias("reasons"))


@query("""SELECT vec_id, CASE WHEN vec_id % 11 = 0 THEN 'bad_feature_rank' WHEN vec_id % 13 = 0 THEN 'empty_feature' END AS reason, vec_id % 11 != 0 AND vec_id % 13 != 0 AS shaped FROM embeddings""")
def q_valid_features(spark, sf):
    k = F.col("vec_id")
    feature = F.when(k % 11 == 0, None).when(k % 13 == 0, F.array().cast("array<array<float>>")).otherwise(F.array("embedding", "embedding"))
    return table(spark, sf, "embeddings").select("vec_id", validity.feature_reason(feature).alias("reason"), validity.has_shape(feature).alias("shaped"))


@query("""SELECT reason, n FROM (UNPIVOT (SELECT count(*) AS rows, count(*) FILTER (WHERE duration_sec IS NULL) AS no_duration, count(*) FILTER (WHERE sampling_rate IS NULL) AS no_rate, count(*) FILTER (WHERE NOT contains(audio_path, '/')) AS invalid_layout, count(*) FILTER (WHERE false) AS never FROM recordings) ON COLUMNS(*) INTO NAME reason VALUE n)""")
def q_valid_counts(spark, sf):
    checks = {"rows": F.lit(True), "no_duration": F.col("duration_sec").isNull(), "no_rate": F.col("sampling_rate").isNull(), "invalid_layout": ~F.col("audio_path").contains("/"), "never": F.lit(False)}
    return validity.check_counts(table(spark, sf, "recordings"), checks)


# selections


@query("""WITH c AS (SELECT rec_id, count(*) AS size FROM segments GROUP BY rec_id), s AS (SELECT *, coalesce(sum(size) OVER (ORDER BY rec_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM c)
SELECT rec_id, size, CAST(least(greatest(3000 - before, 0), size) AS BIGINT) AS take FROM s WHERE before < 3000""")
def q_select_budget(spark, sf):
    chunks = table(spark, sf, "segments").groupBy("rec_id").agg(F.count("*").alias("size"))
    return selection.within_budget(chunks, "rec_id", "size", 3000)


@query("""WITH v AS (SELECT rec_id, start_sec AS lo, end_sec AS hi FROM segments WHERE isfinite(start_sec) AND isfinite(end_sec) AND end_sec >= start_sec), m AS (SELECT *, max(hi) OVER (PARTITION BY rec_id ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM v),
i AS (SELECT *, sum(CASE WHEN reach IS NULL OR lo > reach + 2.5 THEN 1 ELSE 0 END) OVER (PARTITION BY rec_id ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS island FROM m)
SELECT rec_id, min(lo) AS lo, max(hi) AS hi, count(*) AS n FROM i GROUP BY rec_id, island""")
def q_select_merged(spark, sf):
    finite = ~validity.not_finite(F.col("start_sec")) & ~validity.not_finite(F.col("end_sec"))
    rows = table(spark, sf, "segments").where(finite).select("rec_id", F.col("start_sec").alias("lo"), F.col("end_sec").alias("hi"))
    return selection.merged_intervals(rows, ["rec_id"], "lo", "hi", 2.5)


@query("""WITH e AS (SELECT DISTINCT sample_no AS key, unnest(choice_labels) AS label FROM mcq_samples), t AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY md5('5|' || key || '|' || label), label) AS turn FROM e),
r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY turn, md5('5|' || label || '|' || key), key) AS k FROM t WHERE turn <= 2)
SELECT key, label, turn AS copy FROM r WHERE k <= CASE label WHEN 'A' THEN 100 WHEN 'B' THEN 80 WHEN 'C' THEN 60 WHEN 'D' THEN 40 ELSE 0 END""")
def q_select_quota(spark, sf):
    each = table(spark, sf, "mcq_samples").select(F.col("sample_no").alias("key"), F.explode("choice_labels").alias("label"))
    quotas = spark.createDataFrame([("A", 100), ("B", 80), ("C", 60), ("D", 40)], "label string, n bigint")
    return selection.by_quota(each, quotas, "key", "label", 2, 5)


@query()
def q_select_greedy(spark, sf):
    """Without SQL: each step depends on the ones before."""
    each = table(spark, sf, "mcq_samples").select(F.col("sample_no").alias("key"), F.explode("choice_labels").alias("label"))
    return selection.greedy_by_deficit(each, {"A": 40, "B": 30, "C": 20, "D": 10}, "key", "label", 2)


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_totalprice / 1000 - o_custkey >= 2 ORDER BY o_custkey, o_orderkey LIMIT 200")
def q_select_margin(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", "o_custkey", (F.col("o_totalprice") / 1000).alias("up"))
    return selection.margin_filter(rows, "up", "o_custkey", 2, ["o_custkey", "o_orderkey"], 200).select("o_orderkey", "o_custkey")


@query(_PREDS + "SELECT sample_no, pred, second FROM preds WHERE pred IS DISTINCT FROM second ORDER BY sample_no LIMIT 20")
def q_select_changed(spark, sf):
    return selection.changed_rows(_predictions(spark, sf), [("pred", "second")], ["sample_no"], 20).select("sample_no", "pred", "second")


@query("""SELECT session, name FROM (SELECT session_id AS session, 'run-' || (doc_id % 97) AS name, row_number() OVER (PARTITION BY session_id ORDER BY doc_id % 97 DESC) AS r FROM (SELECT DISTINCT session_id, doc_id % 97 AS doc_id FROM documents WHERE session_id IS NOT NULL)) WHERE r = 1""")
def q_select_latest(spark, sf):
    rows = table(spark, sf, "documents").where("session_id is not null").select(F.col("session_id").alias("session"), F.concat(F.lit("run-"), F.col("doc_id") % 97).alias("name"))
    return selection.latest(rows, ["session"], "name")


@query("""SELECT rec_id, CAST(b AS BIGINT) AS steps, CAST(CASE WHEN b > 1 THEN greatest(least(round_even(b * 0.3, 0), b - 1), 1) ELSE 1 END AS BIGINT) AS first FROM (
SELECT rec_id, greatest(ceil(greatest(ceil(greatest(ceil(n / 8.0), 1) / 4.0), 1) * 2.5), 1) AS b FROM (SELECT rec_id, count(*) AS n FROM segments GROUP BY rec_id))""")
def q_select_steps(spark, sf):
    counts = table(spark, sf, "segments").groupBy("rec_id").agg(F.count("*").alias("n"))
    steps = counts.select("rec_id", selection.optimizer_steps(F.col("n"), 4, 4, 2.5, 2).alias("steps"))
    return steps.select("rec_id", "steps", selection.two_stages(F.col("steps"), 0.3)["first"].alias("first"))


@query("""SELECT target_field, label, round(share / sum(share) OVER (PARTITION BY target_field), 6) AS share FROM (SELECT target_field, upper(category) AS label, target_share AS share FROM sample_targets)""")
def q_select_prior(spark, sf):
    raw = table(spark, sf, "sample_targets").groupBy("target_field").agg(F.array_join(F.sort_array(F.collect_list(F.concat_ws(":", "category", F.col("target_share").cast("string")))), ",").alias("raw"))
    return raw.select("target_field", F.explode(selection.parsed_prior(F.col("raw"))).alias("label", "share")).withColumn("share", F.round("share", 6))


@query(_PREDS + """SELECT source, accuracy, place FROM (SELECT source, round(CAST(sum(CASE WHEN is_correct THEN 1 ELSE 0 END) AS DOUBLE) / count(*), 6) AS accuracy, row_number() OVER (ORDER BY round(CAST(sum(CASE WHEN is_correct THEN 1 ELSE 0 END) AS DOUBLE) / count(*), 6) DESC, source) AS place FROM preds WHERE error IS NULL GROUP BY source)""")
def q_sort_breakdown(spark, sf):
    from speechloom.operators import aggregates

    by = aggregates.accuracy_by(_predictions(spark, sf), "source").select("source", "accuracy")
    return sampling.global_rank(by, [F.desc("accuracy"), F.col("source")], "place").withColumn("place", F.col("place").cast("bigint"))


@query("SELECT sample_no, question FROM mcq_samples ORDER BY md5('11|' || sample_no), sample_no LIMIT 100")
def q_sample_head(spark, sf):
    return sampling.first_n(table(spark, sf, "mcq_samples").select("sample_no", "question"), "sample_no", 100, 11)


@query("""WITH q AS (SELECT source, least(count(*), 15) AS n FROM mcq_samples WHERE source IS NOT NULL GROUP BY source), r AS (SELECT source, sample_no, row_number() OVER (PARTITION BY source ORDER BY md5('6|' || sample_no), sample_no) AS k FROM mcq_samples)
SELECT source, sample_no FROM r JOIN q USING (source) WHERE k <= n""")
def q_sample_by_quota(spark, sf):
    rows = table(spark, sf, "mcq_samples").select("source", "sample_no")
    quotas = rows.where("source is not null").groupBy("source").agg(F.least(F.count("*"), F.lit(15)).alias("n"))
    return sampling.draw_by_quota(rows, "source", "sample_no", quotas, 6)


@query("SELECT utt_id, rec_id, text FROM (SELECT *, row_number() OVER (PARTITION BY utt_id ORDER BY ingested_at) AS r FROM segments) WHERE r = 1")
def q_window_first_wins(spark, sf):
    return sampling.first_wins(table(spark, sf, "segments").select("utt_id", "rec_id", "text", "ingested_at"), ["utt_id"], "ingested_at").select("utt_id", "rec_id", "text")


@query("""SELECT user_id, round(quantile_cont(value, 0.2), 6) AS low, round(quantile_cont(value, 0.8), 6) AS high FROM events GROUP BY user_id""")
def q_window_quantiles(spark, sf):
    floors = signal.quantile_floors(table(spark, sf, "events"), ["user_id"], "value")
    return floors.select("user_id", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


# joins


@query("""SELECT o.utt_id, o.rec_id, s.end_cs - s.start_cs AS cs FROM (SELECT DISTINCT utt_id, rec_id, lower(speaker) AS spk, CAST(round_even(start_sec * 100, 0) AS BIGINT) AS start_cs, CAST(round_even(end_sec * 100, 0) AS BIGINT) AS end_cs FROM segments WHERE isfinite(start_sec) AND isfinite(end_sec) AND abs(start_sec) < 1e9 AND abs(end_sec) < 1e9) o
JOIN (SELECT DISTINCT lower(rec_id) AS rec, lower(speaker) AS spk, CAST(round_even(start_sec * 100, 0) AS BIGINT) AS start_cs, CAST(round_even(end_sec * 100, 0) AS BIGINT) AS end_cs FROM segments WHERE isfinite(start_sec) AND isfinite(end_sec) AND abs(start_sec) < 1e9 AND abs(end_sec) < 1e9 AND end_sec > start_sec AND speaker IS NOT NULL) s
ON lower(o.rec_id) = s.rec AND o.spk = s.spk AND o.start_cs = s.start_cs AND o.end_cs = s.end_cs""")
def q_join_segment_keys(spark, sf):
    """Segments on the list of four-part keys that valid ones with a speaker make."""
    from speechloom.operators.intervals import half_even_centiseconds as cs

    rows = table(spark, sf, "segments").where("abs(start_sec) < 1e9 and abs(end_sec) < 1e9").select("utt_id", "rec_id", F.lower("rec_id").alias("rec"), F.lower("speaker").alias("spk"), cs(F.col("start_sec")).alias("start_cs"), cs(F.col("end_sec")).alias("end_cs"), "start_sec", "end_sec").distinct()
    keys = rows.where("end_sec > start_sec and spk is not null").select("rec", "spk", "start_cs", "end_cs").distinct()
    return rows.join(keys, ["rec", "spk", "start_cs", "end_cs"], "left_semi").select("utt_id", "rec_id", (F.col("end_cs") - F.col("start_cs")).alias("cs")).distinct()


@query("""WITH g AS (SELECT audio_id AS session, metadata.question_id AS question_id, max(upper(substr(trim(gold_choice), 1, 1))) AS gold FROM mcq_samples WHERE trim(gold_choice) != '' AND split = 'train' GROUP BY ALL),
r AS (SELECT sample_no, audio_id AS session, metadata.question_id AS question_id, CASE WHEN sample_no % 3 = 0 THEN NULL ELSE upper(trim(gold_choice)) END AS gold FROM mcq_samples)
SELECT sample_no, CASE WHEN r.gold IN ('A', 'B', 'C', 'D') THEN r.gold ELSE g.gold END AS gold_choice FROM r LEFT JOIN g ON r.session = g.session AND r.question_id = g.question_id WHERE CASE WHEN r.gold IN ('A', 'B', 'C', 'D') THEN r.gold ELSE g.gold END IN ('A', 'B', 'C', 'D')""")
def q_join_gold_lookup(spark, sf):
    rows = table(spark, sf, "mcq_samples").select("sample_no", "split", F.col("audio_id").alias("session"), F.col("metadata.question_id").alias("question_id"), "gold_choice")
    golds = rows.where("split = 'train' and trim(gold_choice) != ''").groupBy("session", "question_id").agg(F.max(F.upper(F.substring(F.trim("gold_choice"), 1, 1))).alias("gold"))
    asked = rows.withColumn("gold_choice", F.when(F.col("sample_no") % 3 != 0, F.upper(F.trim("gold_choice"))))
    return ingest.with_gold(asked, golds, ["A", "B", "C", "D"]).select("sample_no", "gold_choice")


@query("""WITH d AS (SELECT rec_id, regexp_replace(list_extract(string_split(audio_path, '/'), -1), '\\.[^.]*$', '') AS stem FROM recordings), t AS (SELECT session_id || '_001_studio' AS name, max(text) AS text FROM documents WHERE session_id IS NOT NULL GROUP BY 1)
SELECT rec_id, coalesce(text, '') AS transcript FROM d LEFT JOIN t ON d.stem = t.name""")
def q_join_transcripts(spark, sf):
    texts = table(spark, sf, "documents").where("session_id is not null").select(F.concat("session_id", F.lit("_001_studio")).alias("name"), "text")
    return corpora.with_text_by_stem(table(spark, sf, "recordings"), "audio_path", texts, "name", "text").select("rec_id", "transcript")


@query("""WITH f AS (SELECT utt_id, max(rec_id || ' filled') AS value FROM segments GROUP BY utt_id) SELECT DISTINCT s.utt_id, CASE WHEN s.speaker IS NULL OR trim(s.speaker) = 'spk_unk' THEN coalesce(f.value, s.speaker) ELSE s.speaker END AS speaker FROM segments s LEFT JOIN f USING (utt_id)""")
def q_join_filled(spark, sf):
    rows = table(spark, sf, "segments").select("utt_id", "rec_id", "speaker")
    fixes = rows.groupBy("utt_id").agg(F.max(F.concat("rec_id", F.lit(" filled"))).alias("value"))
    return corpora.filled(rows.drop("rec_id").distinct(), "utt_id", "speaker", fixes, "spk_unk").select("utt_id", "speaker").distinct()


@query("""SELECT split, count(*) AS audio, count(s.audio_path) AS seen, round(count(s.audio_path) / count(*), 6) AS share FROM (SELECT DISTINCT split, audio_path FROM mcq_samples WHERE split != 'train' AND audio_path IS NOT NULL) e
LEFT JOIN (SELECT DISTINCT audio_path FROM mcq_samples WHERE split = 'train') s USING (audio_path) GROUP BY split""")
def q_join_audio_overlap(spark, sf):
    rows = table(spark, sf, "mcq_samples").select("split", "audio_path")
    return corpora.audio_overlap(rows.where("split = 'train'"), rows.where("split != 'train'"), "audio_path", "split")


@query("""WITH a AS (SELECT DISTINCT audio_path FROM mcq_samples WHERE audio_path IS NOT NULL), s AS (SELECT sha1(audio_path) AS audio_id, (row_number() OVER (ORDER BY md5('3|' || sha1(audio_path)), sha1(audio_path)) - 1) % 4 AS shard FROM a)
SELECT sample_no FROM mcq_samples m JOIN s ON sha1(m.audio_path) = s.audio_id WHERE s.shard = 1""")
def q_join_audio_shard(spark, sf):
    rows = table(spark, sf, "mcq_samples").select("sample_no", "audio_path")
    shards = sampling.round_robin_shards(rows.select(F.sha1("audio_path").alias("audio_id")), "audio_id", 4, 3)
    return corpora.of_shard(rows, shards, "audio_path", 1).select("sample_no")


@query("""SELECT sample_no, p.l AS label, p.t AS text FROM (SELECT sample_no, unnest(list_transform(choice_labels, lambda x: {'l': x, 't': choices[x]})) AS p FROM mcq_samples)""")
def q_join_zipped(spark, sf):
    texts = F.transform("choice_labels", lambda x: F.try_element_at("choices", x))
    rows = table(spark, sf, "mcq_samples").select("sample_no", F.inline(corpora.zipped(F.col("choice_labels"), texts, ("label", "text"))))
    return rows.select("sample_no", "label", "text")


@query("""SELECT sample_no, array_to_string(list_transform(choice_labels, lambda x: CASE WHEN x = 'A' AND sample_no % 2 = 0 THEN 'fixed' ELSE coalesce(choices[x], '') END), '|') AS texts FROM mcq_samples""")
def q_join_write_back(spark, sf):
    rows = table(spark, sf, "mcq_samples").select("sample_no", mcq.options_in_order(F.col("choice_labels"), F.col("choices")).alias("options"))
    fixes = rows.where("sample_no % 2 = 0").select("sample_no", F.posexplode("options").alias("pos", "o")).where("o.label = 'A'").select("sample_no", "pos", F.lit("fixed").alias("value"))
    made = joins.write_back(rows, "sample_no", "options", "text", fixes)
    return made.select("sample_no", F.array_join(F.transform("options", lambda o: F.coalesce(o["text"], F.lit(""))), "|").alias("texts"))


@query("""SELECT doc_id, source FROM documents WHERE doc_id::VARCHAR NOT IN (SELECT DISTINCT split_part(path, '.', 1) FROM (SELECT (doc_id * 2) || '.txt' AS path FROM documents))""")
def q_join_missing_outputs(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "source", F.concat("doc_id", F.lit(".wav")).alias("path"))
    done = docs.select(F.concat(F.lit("out/"), F.col("doc_id") * 2, F.lit(".txt")).alias("made"))
    return files.missing_outputs(docs, "path", done, "made").select("doc_id", "source")


# sets and corpora


@query("""SELECT 'dev' AS part, sample_no FROM mcq_samples WHERE split = 'dev' UNION ALL SELECT 'test', sample_no FROM mcq_samples WHERE split = 'test' UNION ALL SELECT 'dev again', sample_no FROM mcq_samples WHERE split = 'dev'""")
def q_set_union(spark, sf):
    rows = table(spark, sf, "mcq_samples").select("split", "sample_no")
    parts = [(n, rows.where(F.col("split") == s).select("sample_no")) for n, s in (("dev", "dev"), ("test", "test"), ("dev again", "dev"))]
    return corpora.union_all(parts)


@query("""SELECT sample_no, unnest(generate_series(1, CASE WHEN lower(trim(language)) LIKE 'en%' THEN 2 ELSE 1 END)) AS copy FROM mcq_samples""")
def q_set_replayed(spark, sf):
    rows = table(spark, sf, "mcq_samples").select("sample_no", "language")
    return corpora.replayed(rows, F.lower(F.trim("language")).startswith("en"), 2).select("sample_no", F.col("copy").cast("bigint").alias("copy"))


@query("""SELECT coalesce(a.language, b.language) AS language, CASE WHEN a.language IS NULL THEN 'second' WHEN b.language IS NULL THEN 'first' ELSE 'both' END AS side FROM (SELECT DISTINCT language FROM segments WHERE language IS NOT NULL) a FULL JOIN (SELECT DISTINCT language FROM mcq_samples WHERE language IS NOT NULL) b ON a.language = b.language""")
def q_set_languages(spark, sf):
    return corpora.shared_and_own(table(spark, sf, "segments", "language"), table(spark, sf, "mcq_samples", "language"), "language")


@query("SELECT source, count(*) FILTER (WHERE split = 'train') AS train, count(*) FILTER (WHERE split = 'dev') AS dev, count(*) FILTER (WHERE split = 'test') AS test FROM mcq_samples GROUP BY source")
def q_set_wide_counts(spark, sf):
    return corpora.wide_counts(table(spark, sf, "mcq_samples"), "source", "split", ["train", "dev", "test"])


@query("""WITH r AS (SELECT source, lower(trim(language)) AS a, CASE WHEN sample_no % 3 = 0 THEN 'english' ELSE lower(trim(language)) END AS t FROM mcq_samples), m AS (SELECT source, CASE WHEN a = 'english' AND t = 'english' THEN 'base' WHEN t = 'english' AND a != 'english' THEN 'cross' WHEN a = t THEN 'same' ELSE 'other' END AS mix FROM r)
SELECT source, mix, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY source), 6) AS share FROM m GROUP BY source, mix""")
def q_set_mix_shares(spark, sf):
    rows = table(spark, sf, "mcq_samples").select("source", F.col("language").alias("a"), F.when(F.col("sample_no") % 3 == 0, "english").otherwise(F.col("language")).alias("t"))
    return corpora.mix_shares(rows, "a", "t", ["source"], "english")


def _weights(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("label").cast("string").alias("name"), "vec_id", F.posexplode(F.transform("embedding", lambda x: x.cast("double"))).alias("i", "v")).withColumn("at", F.concat_ws(":", "vec_id", "i"))


@query("""WITH w AS (SELECT CAST(label AS VARCHAR) AS name, vec_id, unnest(generate_series(0, len(embedding) - 1)) AS i, unnest(embedding) AS v FROM embeddings)
SELECT name, count(*) AS total, count(*) FILTER (WHERE v != 0) AS nnz_before, count(*) FILTER (WHERE v > 0) AS nnz_after, round(count(*) FILTER (WHERE v > 0) / count(*) FILTER (WHERE v != 0), 6) AS kept_ratio FROM w GROUP BY name""")
def q_set_mask_statistics(spark, sf):
    w = _weights(spark, sf)
    return corpora.mask_statistics(w, w.where("v > 0"), "name", "at", "v")


@query("""WITH w AS (SELECT CAST(label AS VARCHAR) AS name, vec_id, unnest(generate_series(0, len(embedding) - 1)) AS i, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)
SELECT name, round(sum(v * CASE WHEN v > 0 THEN v ELSE 0 END) / (sqrt(sum(v * v)) * sqrt(sum(CASE WHEN v > 0 THEN v * v ELSE 0 END))), 6) AS cosine, round(sqrt(sum(v * v)), 6) AS norm_first, round(sqrt(sum(CASE WHEN v > 0 THEN v * v ELSE 0 END)), 6) AS norm_second FROM w GROUP BY name""")
def q_set_cosines(spark, sf):
    w = _weights(spark, sf)
    return corpora.cosine_by_name(w, w.where("v > 0"), "name", ["at"], "v")


@query("""SELECT p_brand AS module, p_brand || '.lora_A.weight' AS first, p_brand || '.lora_B.weight' AS second FROM part GROUP BY p_brand HAVING bool_or(p_size % 2 = 0) AND bool_or(p_size % 2 = 1)""")
def q_set_paired_factors(spark, sf):
    names = table(spark, sf, "part").select(F.concat("p_brand", F.when(F.col("p_size") % 2 == 0, ".lora_A.weight").otherwise(".lora_B.weight")).alias("name"))
    return corpora.paired_factors(names, "name")


@query("""SELECT l_returnflag AS name, l_linenumber AS i, l_linestatus AS j, round(sum(l_quantity * 2), 6) AS v FROM lineitem GROUP BY ALL""")
def q_set_products(spark, sf):
    """Each row of lineitem is a cell of one matrix; the other has a 2 where its column meets the line's status."""
    left = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("name"), F.col("l_linenumber").alias("i"), F.col("l_linestatus").alias("j"), F.col("l_quantity").alias("v"))
    right = left.select("name", F.col("j").alias("i"), "j").distinct().withColumn("v", F.lit(2.0))
    return corpora.product_table(left, right, "name", "i", "j", "v").withColumn("v", F.round("v", 6))


@query("""SELECT p_name AS name, CASE WHEN regexp_matches(lower(p_name), 'audio_tower|encoder') THEN 'encoder' WHEN regexp_matches(lower(p_name), 'multi_modal_projector|connector|adapter') THEN 'connector' ELSE 'decoder' END AS part, NOT regexp_matches(lower(p_name), 'bias$|norm|embed') AS decays, false AS is_adapter FROM (SELECT DISTINCT p_name FROM part)""")
def q_set_parameter_groups(spark, sf):
    return corpora.parameter_groups(table(spark, sf, "part").select(F.col("p_name").alias("name")), "name")


@query("""SELECT sha1(audio_path) AS audio_id, audio_path, array_to_string(list_sort(list(DISTINCT split)), ' ') AS splits FROM mcq_samples WHERE audio_path IS NOT NULL GROUP BY audio_path""")
def q_set_audio_table(spark, sf):
    return files.audio_table(table(spark, sf, "mcq_samples"), "audio_path", "split").withColumn("splits", F.array_join("splits", " "))


@query("""WITH p AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS position FROM documents) SELECT position // 150 AS shard, min(position) AS start, max(position) + 1 AS end, count(*) AS rows FROM p GROUP BY 1""")
def q_shard_blocks(spark, sf):
    placed = files.block_shards(table(spark, sf, "documents").select("doc_id"), ["doc_id"], 150)
    return files.manifest(placed, "shard", "position")


@query("""SELECT split, sample_no % 4 AS shard, count(*) AS rows, count(DISTINCT sample_no) AS different, true AS unique FROM mcq_samples GROUP BY split, sample_no % 4""")
def q_shard_merged(spark, sf):
    """Rows by split and modulo shard, and whether the merged keys are unique."""
    rows = table(spark, sf, "mcq_samples").select("split", "sample_no", (F.col("sample_no") % 4).alias("shard"))
    check = files.merged_shards(rows, "shard", "sample_no", ["sample_no"])[1].select("unique")
    counts = rows.groupBy("split", "shard").agg(F.count("*").alias("rows"), F.count_distinct("sample_no").alias("different"))
    return counts.crossJoin(F.broadcast(check))  # one row


@query("SELECT utt_id || ' 1 spk1 0.00 1.00 ' || coalesce(text, '') AS value FROM segments WHERE trim(coalesce(utt_id, '')) != ''")
def q_text_stm(spark, sf):
    return files.stm_lines(table(spark, sf, "segments"), "utt_id", "text")


@query("""SELECT audio_path, array_to_string(list(sample_id ORDER BY sample_no), ' ') AS items FROM mcq_samples WHERE audio_path IS NOT NULL GROUP BY audio_path""")
def q_set_regrouped(spark, sf):
    rows = table(spark, sf, "mcq_samples").where("audio_path is not null").select("audio_path", "sample_id", "sample_no")
    return selection.regrouped(rows, "audio_path", "sample_id", "sample_no").select("audio_path", F.array_join("items", " ").alias("items"))


# questions


@query()
def q_ingest_samples(spark, sf):
    """Without SQL: the layouts of the lines are those of p7_found."""
    made = ingest.samples(nested.json_nodes(table(spark, sf, "mcq_jsonl"), "line_no", "jsonl"))
    return made.select("sample_id", "audio_path", "question", "gold_choice", F.size("options").alias("n_options"), "sample_weight", F.col("attributes")["language"].alias("language"))


@query()
def q_ingest_evaluation(spark, sf):
    """Without SQL, as q_ingest_samples; the audio of the recordings is the index."""
    index = ingest.audio_index(table(spark, sf, "recordings").select("audio_path"), "audio_path")
    rows = ingest.evaluation_rows(nested.json_nodes(table(spark, sf, "mcq_jsonl"), "line_no", "jsonl"), index, neutral=True)
    return rows.select("line_no", "question_idx", "gold_choice", F.array_join(F.transform("options", lambda o: o["label"]), " ").alias("labels"), "audio_path")


@query("""SELECT sample_no, CASE WHEN len(choice_labels) = 2 THEN '1 2' ELSE array_to_string(choice_labels, ' ') END AS labels, CASE WHEN len(choice_labels) = 2 AND list_contains(choice_labels, g) THEN CAST(list_position(choice_labels, g) AS VARCHAR) ELSE g END AS gold FROM (SELECT *, upper(trim(gold_choice)) AS g FROM mcq_samples)""")
def q_mcq_neutral_labels(spark, sf):
    rows = table(spark, sf, "mcq_samples").select("sample_no", F.upper(F.trim("gold_choice")).alias("g"), mcq.options_in_order(F.col("choice_labels"), F.col("choices")).alias("o"))
    options, gold, _ = ingest.neutral_labels(F.col("o"), F.col("g"))
    return rows.select("sample_no", F.array_join(F.transform(options, lambda o: o["label"]), " ").alias("labels"), gold.alias("gold"))


@query("""SELECT sample_no, array_to_string(list_sort(list_transform(list_distinct(map_values(choices)), lambda v: v || '=' || list_filter(map_keys(choices), lambda k: choices[k] = v)[-1])), '|') AS pairs FROM mcq_samples""")
def q_mcq_reversed_map(spark, sf):
    back = ingest.reversed_map(F.map_filter("choices", lambda _, v: v.isNotNull()))
    return table(spark, sf, "mcq_samples").select("sample_no", F.array_join(F.sort_array(F.transform(F.map_entries(back), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), "|").alias("pairs"))


@query("""SELECT sample_no, array_to_string(list_transform(choice_labels, lambda x: upper(trim(x))), ' ') AS labels FROM mcq_samples""")
def q_mcq_choice_map(spark, sf):
    rows = table(spark, sf, "mcq_samples").select("sample_no", mcq.first_place_last_text(mcq.options_in_order(F.col("choice_labels"), F.col("choices"))).alias("o"))
    return rows.select("sample_no", F.array_join(F.transform("o", lambda o: o["label"]), " ").alias("labels"))


@query(_PROBS + "SELECT vec_id, round(list_max(e) + ln(list_sum(list_transform(e, lambda x: exp(x - list_max(e))))), 6) AS mass FROM s")
def q_mcq_token_mass(spark, sf):
    entries = F.transform("embedding", lambda x: x.cast("double"))
    every_fourth = lambda k: F.filter(entries, lambda _, i: i % 4 == k)
    four = F.array(*(F.round(F.aggregate(every_fourth(k), F.lit(0.0), lambda a, x: a + x), 9) for k in range(4)))
    return table(spark, sf, "embeddings").select("vec_id", F.round(mcq.log_sum_exp(four), 6).alias("mass"))


@query(_PROBS + """, c AS (SELECT vec_id, CAST(list_position(probs, list_max(probs)) AS INT) AS before, list_transform(probs, lambda x, i: round(ln(greatest(x, 1e-9)) + [0.1, -0.2, 0.3, 0.0][i], 9)) AS z FROM p)
SELECT vec_id, substr('ABCD', before, 1) AS before, substr('ABCD', CAST(list_position(z, list_max(z)) AS INT), 1) AS after FROM c""")
def q_mcq_calibrated(spark, sf):
    return pipelines.apply_calibration(_probs(spark, sf), ["vec_id"], "probs", [0.1, -0.2, 0.3, 0.0], ["A", "B", "C", "D"])


@query()
def q_mcq_cyclic_choice(spark, sf):
    """Without SQL: a stand-in model scores the rotations."""
    texts = F.transform("choice_labels", lambda x: F.try_element_at("choices", x))
    rows = table(spark, sf, "mcq_samples").select("sample_no", "question", F.col("choice_labels").alias("labels"), texts.alias("texts"))
    return batches.cyclic_choice(rows, ["sample_no"], "question", "labels", "texts", batches.stub_scores)


@query()
def q_mcq_proxy(spark, sf):
    """Without SQL: labels by largest remainder, then quotas and text swaps, each of which has its own."""
    options = mcq.options_in_order(F.col("choice_labels"), F.col("choices"))
    rows = table(spark, sf, "mcq_samples").select(F.col("sample_no").alias("key"), options.alias("options"), F.upper(F.trim("gold_choice")).alias("gold"))
    made = pipelines.proxy_questions(rows, {"A": 0.4, "B": 0.3, "C": 0.2, "D": 0.1}, 0.5, 2)
    return made.select("key", "label", "copy", "gold")


@query("SELECT doc_id, array_to_string(list_transform([0, 1, 2], lambda i: CAST((doc_id // 16 + i) % 20 AS VARCHAR)), ' ') AS shots FROM documents")
def q_mcq_rotated_shots(spark, sf):
    rows = batches.rotated_shots(table(spark, sf, "documents").select("doc_id"), "doc_id", 16, 20, 3)
    return rows.select("doc_id", F.array_join(F.transform("shots", lambda x: x.cast("string")), " ").alias("shots"))


# signals and scores


@query("""SELECT vec_id, CAST(i AS INT) AS frame, round(sqrt(list_sum(list_transform(embedding[i * 4 + 1:i * 4 + 8], lambda x: CAST(x AS DOUBLE) * x)) / 8), 6) AS level FROM (SELECT vec_id, embedding, unnest(generate_series(0, (len(embedding) - 8) // 4)) AS i FROM embeddings)""")
def q_signal_levels(spark, sf):
    made = table(spark, sf, "embeddings").select("vec_id", F.posexplode(signal.frame_levels(F.col("embedding"), 8, 4)).alias("frame", "level"))
    return made.select("vec_id", "frame", F.round("level", 6).alias("level"))


@query()
def q_signal_speech(spark, sf):
    """Without SQL: runs of frames over interpolated quantiles of 32-bit energies."""
    rows = table(spark, sf, "embeddings").select("vec_id", "embedding", F.lit(400).alias("rate"))
    return signal.speech_spans(rows, "vec_id", "embedding", "rate", 0.5, 20.0).select("vec_id", F.size("spans").alias("spans"), F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, s: a + s["end"] - s["start"]).alias("samples"))


@query("SELECT vec_id, CAST(len(embedding) + 6 AS INT) AS size, CAST(len(embedding) AS BIGINT) AS own FROM embeddings")
def q_signal_padded(spark, sf):
    made = table(spark, sf, "embeddings").select("vec_id", signal.padded(F.col("embedding"), F.size("embedding") + 6).alias("p"))
    return made.select("vec_id", F.size("p.values").alias("size"), F.aggregate("p.mask", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("own"))


@query()
def q_signal_crop_plan(spark, sf):
    """Without SQL: a hashed place where a question names no time."""
    plan = signal.crop_plan(F.col("audio_path"), F.col("question"), F.lit(600.0), F.col("sample_id"), 5.0, 30.0)
    return table(spark, sf, "mcq_samples").select("sample_no", plan.alias("p")).select("sample_no", F.size("p.windows").alias("windows"), F.col("p.key").alias("key"))


@query("""WITH s AS (SELECT DISTINCT utt_id, list_filter(string_split(trim(text), ' '), lambda w: w != '') AS w FROM segments WHERE trim(text) != '')
SELECT round(CAST(sum(len(w) // 4) AS DOUBLE) / sum(len(w)), 6) AS corpus, round(avg((len(w) // 4) / len(w)), 6) AS mean_sentence, round(max((len(w) // 4) / len(w)), 6) AS worst_sentence FROM s""")
def q_metric_sentence_rates(spark, sf):
    rows = metrics.with_word_errors(_scored(spark, sf).drop("language").distinct(), "reference", "hypothesis")
    return metrics.sentence_rates(rows, "word_edits", "words")


@query("""WITH w AS (SELECT DISTINCT utt_id, language, list_filter(string_split(trim(text), ' '), lambda w: w != '') AS w FROM segments WHERE trim(text) != ''), s AS (SELECT language, w, length(array_to_string(w, ' ')) AS n, length(array_to_string(list_filter(w, lambda x, i: i % 4 != 0), ' ')) AS m FROM w)
SELECT CASE WHEN grouping(language) = 0 THEN language END AS language, CAST(sum(len(w) // 4) AS BIGINT) AS edits, CAST(sum(len(w)) AS BIGINT) AS units, round(CAST(sum(len(w) // 4) AS DOUBLE) / sum(len(w)), 6) AS rate, CAST(sum(n - m) AS BIGINT) AS character_edits, CAST(sum(n) AS BIGINT) AS characters, round(CAST(sum(n - m) AS DOUBLE) / sum(n), 6) AS character_rate
FROM s GROUP BY GROUPING SETS ((language), ()) HAVING grouping(language) = 1 OR language IS NOT NULL""")
def q_metric_scores_legacy(spark, sf):
    return pipelines.speech_scores(_scored(spark, sf), "reference", "hypothesis", "language", "legacy")


@query()
def q_metric_scores_both_sides(spark, sf):
    """Without SQL: edit distances of texts of any form."""
    return pipelines.speech_scores(_scored(spark, sf), "reference", "hypothesis", "language", "normalization_both_sides")


@query("""SELECT user_id AS run, round(abs(avg(value) FILTER (WHERE event_type = 'click') - avg(value) FILTER (WHERE event_type != 'click')), 6) AS gap FROM events GROUP BY user_id""")
def q_metric_gap(spark, sf):
    click = F.col("event_type") == "click"
    return table(spark, sf, "events").groupBy(F.col("user_id").alias("run")).agg(F.round(F.abs(F.avg(F.when(click, F.col("value"))) - F.avg(F.when(~click, F.col("value")))), 6).alias("gap"))


@query("""SELECT user_id, event_id, min(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS best FROM events""")
def q_window_best_so_far(spark, sf):
    return sampling.running_least(table(spark, sf, "events").select("user_id", "event_id", "value"), ["user_id"], ["event_id"], "value").select("user_id", "event_id", "best")


# windows over event time (an extension)


@query("SELECT CAST(date_trunc('minute', ts) AS TIMESTAMP) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2")
def q_stream_tumbling(spark, sf):
    from speechloom.streaming import windows

    return windows.tumbling(table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("""WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events), i AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS island FROM e)
SELECT user_id, CAST(min(ts) AS TIMESTAMP) AS start, CAST(max(ts) + INTERVAL 30 MINUTE AS TIMESTAMP) AS end, count(*) AS n FROM i GROUP BY user_id, island""")
def q_stream_sessions(spark, sf):
    from speechloom.streaming import windows

    made = windows.sessions(table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")))
    return made.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})
