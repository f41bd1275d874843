import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from speechloom.functions import text as tx
from speechloom.functions import timeref
from speechloom.operators import joins, mcq, metrics, sampling, selection
from speechloom.plans import pipelines, reference
from speechloom.sources import kaldi
from speechloom.streaming import windows


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(
    "token,seconds", [("1:02:03", 3723.0), ("5 min", 300.0), ("abc", None), ("12,5", 12.5), ("1:30", 90.0), ("1:30.5", 90.5), ("1:-3", None), ("1:2:3:4", None), ("2h", 7200.0), ("", None), (None, None)]
)
def test_seconds_of(spark, token, seconds):
    assert one(spark, token, timeref.seconds_of) == seconds


@pytest.mark.parametrize(
    "text,ranges",
    [("compare 12,5 s to 20 s", [(12.5, 20.0)]), ("at 1:30-2:00", [(90.0, 90.0), (90.0, 120.0)]), ("01:00-02:00", [(60.0, 120.0)]), ("see 1:5 and 7", [(65.0, 65.0)]), ("time: 30", []), ("AT 3:10:20 or 4:00", [(240.0, 240.0), (11420.0, 11420.0)]), ("wait 5 hours to 6 h", [(18000.0, 21600.0)]), ("that 5 times", [(5.0, 5.0)]), ("in 2024-25", [(25.0, 2024.0)]), ("[22.12, 24.83]", [(22.12, 24.83)]), (None, []), ("", [])],
)
def test_time_ranges(spark, text, ranges):
    assert [tuple(r) for r in one(spark, text, timeref.time_ranges)] == ranges


def test_chunks_cover_the_recording(spark):
    get = lambda d: [tuple(c) for c in one(spark, d, lambda x: timeref.chunks(x, 60.0, 2.0), "double")]
    assert get(130.0) == [(0, 60), (58, 118), (116, 130)]
    assert get(118.0) == [(0, 60), (58, 118)]
    assert get(0.0) == []


def test_local_time(spark):
    df = spark.sql("select array(struct(10D as lo, 20D as hi), struct(15D as lo, 30D as hi)) as w")
    assert df.select(timeref.local_time(F.lit(16.0), F.col("w")).alias("a"), timeref.local_time(F.lit(25.0), F.col("w")).alias("b"), timeref.local_time(F.lit(99.0), F.col("w")).alias("c")).first() == (6.0, 20.0, None)


def test_loop_cut():
    assert tx.cut_loop(" ".join(["a b c d e"] * 6)) == " ".join(["a b c d e"] * 6)
    assert tx.cut_loop(" ".join(["a b c d e"] * 7)) == "a b c d e"
    assert tx.cut_loop(None) is None and tx.cut_loop("") == ""


def test_text_functions(spark):
    assert one(spark, "ljubav", tx.serbian_cyrillic) == "љубав"
    assert one(spark, "no no no no yes", tx.single_runs_collapsed) == "no yes"
    assert one(spark, "An apple: B", tx.first_option_letter) == "A"
    assert one(spark, "banana", tx.first_option_letter) == "?"
    assert one(spark, "กัน x", tx.normalize_label) == "ก น x"
    labels = F.array(*(F.lit(x) for x in "ABCD"))
    for text, picked in (("The answer is B.", "B"), ("A dog barks", "A"), ("banana", "A"), (" c ", "C")):
        assert one(spark, text, lambda x: tx.pick_option(x, labels)) == picked
    assert one(spark, "a b c d", lambda x: tx.merge_overlap(x, F.lit("c d e"), 6)) == "a b c d e"
    masked, found = tx.mask(F.col("x"), r"\d+:\d\d", "TS", "TS")
    times = " ".join(f"{i}:00" for i in range(12))
    row = spark.createDataFrame([(times,)], "x string").select(masked.alias("m"), found.alias("f")).select("m", tx.unmask(F.col("m"), F.col("f"), "TS", "TS").alias("u")).first()
    assert row.m.startswith("TS0TS TS1TS") and row.u == times


def test_options(spark):
    df = spark.sql("select array(struct('a' as label,'p' as text), struct('A' as label,'q' as text), struct('B' as label,'r' as text)) as o, 'A' as g")
    kept = df.select(mcq.first_place_last_text(F.col("o")).alias("o"), "g")
    assert [tuple(x) for x in kept.first().o] == [("A", "q"), ("B", "r")]
    swapped = mcq.swap_variants(kept, "o", "g").orderBy("variant").collect()
    assert [[x.label for x in r.o] for r in swapped] == [["A", "B"], ["B", "A"]]
    moved = kept.select(mcq.target_variant(F.col("o"), F.col("g"), F.lit("B")).alias("o")).first().o
    assert [tuple(x) for x in moved] == [("A", "r"), ("B", "q")]


def test_word_errors(spark):
    df = spark.createDataFrame([("a b c", "a x c d"), ("", "x"), (None, None)], "r string, h string")
    assert [(r.word_edits, r.words) for r in metrics.with_word_errors(df, "r", "h").collect()] == [(2, 3), (1, 0), (0, 0)]
    assert metrics.align("a b c".split(), "a x c d".split()) == (2, 1, 0, 1)
    assert metrics.error_rate(metrics.with_word_errors(df.where("r = 'a b c'"), "r", "h"), "word_edits", "words").first().rate == 0.666667


def test_apportionment_and_shards(spark, rows):
    prior = spark.createDataFrame([(x, 0.25) for x in "ABCD"], "label string, share double")
    assert rows(sampling.largest_remainder(prior, "label", "share", 10)) == [("A", 3), ("B", 3), ("C", 2), ("D", 2)]
    ten = spark.range(10)
    assert [r[1] for r in rows(sampling.contiguous_shards(ten, ["id"], 4).groupBy("shard").count())] == [3, 3, 2, 2]
    five = spark.createDataFrame([(f"s{i}", i) for i in range(5)], "s string, p bigint")
    assert [r[1] for r in rows(sampling.session_shards(five, "s", "p", 4))] == [0, 0, 1, 2, 3]
    split = sampling.train_eval_split(ten, "id", 0.15)
    assert split.where("is_eval").count() == 2
    parts = sampling.stratified_partitions(spark.range(12).selectExpr("id", "if(id < 10, 'x', 'y') as c"), "c", "id", 0.15, 0.15)
    assert rows(parts.groupBy("c", "part").count()) == [("x", "test", 2), ("x", "train", 6), ("x", "validation", 2), ("y", "test", 2)]
    values = spark.createDataFrame([(1, i, float(i)) for i in range(1, 6)], "g int, i int, v double")
    assert [r.smoothed for r in sampling.moving_average(values, ["g"], "i", "v", 5).orderBy("i").collect()] == [1.2, 2.0, 3.0, 2.8, 2.4]
    top = spark.createDataFrame([("t", i, x) for i, x in enumerate([0.0, 3.0, -1.0, 2.0])], "n string, i int, v double")
    assert rows(sampling.top_magnitudes(top, "n", "i", "v", 0.5).select("v")) == [(2.0,), (3.0,)]
    assert sampling.global_rank(spark.range(100).orderBy(F.rand(1)), ["id"]).where("rank != id + 1").count() == 0
    assert sampling.contiguous_shards(ten.limit(0), ["id"], 4).count() == 0


def test_joins(spark, rows):
    left = spark.createDataFrame([("f", 1), ("f", 2), ("g", 1)], "k string, t int")
    right = spark.createDataFrame([("f", 5), ("f", 4), ("g", 1), ("g", 2)], "k string, t int")
    assert rows(joins.rank_aligned(left, right, ["k"], "t")) == [("f", 1, 1, 4), ("f", 2, 2, 5)]
    names = spark.createDataFrame([("a",), (" B ",)], "name string")
    data = spark.createDataFrame([("a", "b"), ("x", "b"), ("x", "y"), (None, None)], "p string, q string")
    assert rows(joins.allowed(data, names, "name", [F.col("p"), F.col("q")])) == [("a", "b"), ("x", "b")]
    records = spark.sql("select 1 as k, array(struct('q' as t, 1 as n), struct('r' as t, 2 as n)) as items")
    fixes = spark.createDataFrame([(1, 1, "R")], "k int, pos int, value string")
    assert [tuple(x) for x in joins.write_back(records, "k", "items", "t", fixes).first()["items"]] == [("q", 1), ("R", 2)]


def test_kaldi_round_trip(spark, rows, tmp_path):
    rec = spark.createDataFrame([("r1", "a/b.wav", "en")], "rec_id string, audio_path string, language string")
    seg = spark.createDataFrame([("u1", "r1", 0.5, 1.25, "s", "hello there", None), ("u2", "r1", 2.0, 1.0, None, None, "fr")], "utt_id string, rec_id string, start_sec double, end_sec double, speaker string, text string, language string")
    kaldi.write_relations(rec, seg, str(tmp_path))
    assert rows(kaldi.read_segments(spark, f"{tmp_path}/segments")) == [("u1", "r1", 0.5, 1.25)]
    assert rows(kaldi.read_map(spark, f"{tmp_path}/text")) == [("u1", "hello there")]
    (tmp_path / "m").write_text("a 1\na  2 3 \nb\n\n")
    assert rows(kaldi.read_map(spark, str(tmp_path / "m"))) == [("a", "2 3")]
    lines = spark.createDataFrame([("0.5 1.0 spk hello you",), ("2 1 spk x",), ("nonsense",), ("",)], "line string")
    parsed = kaldi.parse_segment_lines(lines)
    assert parsed.where("kept").count() == 1 and parsed.where("rejected").count() == 1
    (tmp_path / "log").write_text('{"global_step": 1, "checkpoint_dir": "c1", "generalization_gap": -0.2}\nbroken\n{"global_step": 2, "checkpoint_dir": "c2", "generalization_gap": 0.1}\n')
    assert kaldi.best_checkpoint(kaldi.read_training_log(spark, str(tmp_path / "log"))).first()[0] == "c2"


def test_wav(spark, tmp_path):
    with wave.open(str(tmp_path / "x.wav"), "wb") as f:
        f.setnchannels(2)
        f.setsampwidth(2)
        f.setframerate(8000)
        f.writeframes(np.array([[16384, 0]] * 4000, "<i2").tobytes())
    (tmp_path / "y.wav").write_bytes(b"junk")
    got = {r.path.rsplit("/", 1)[1]: r for r in kaldi.read_wav(spark, str(tmp_path)).collect()}
    assert got["x.wav"].duration_sec == 0.5 and got["x.wav"].silent is False and got["y.wav"].error
    x, rate = kaldi.decode_pcm((tmp_path / "x.wav").read_bytes())
    assert rate == 8000 and np.allclose(x, 0.25)


def test_stream_equals_batch(spark, rows, tmp_path):
    events = spark.range(200).selectExpr("id as event_id", "timestamp_seconds(1700000000 + id * 37) as ts", "id % 5 as user_id", "if(id % 3 = 0, 'click', 'view') as event_type", "cast(id as double) as value", "'{}' as props")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = windows.tumbling(windows.event_stream(spark, str(tmp_path / "in"), 10))
    query = stream.writeStream.format("memory").queryName("tumbled").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert rows(spark.table("tumbled")) == rows(windows.tumbling(events))


def test_labels_of_any_script(spark, rows, tmp_path):
    asked = [(1, " Who SANG, at 5:30? ", " b", "English"), (2, "Où est l'ÉCOLE – là-bas?", "a", " French "), (3, "Кто ПОЁТ?", "c", "russian"), (4, "誰が歌う？　二回", "d", ""), (5, "누가 노래해?", None, None), (6, None, "a", "greek"), (7, "", "a", "greek")]
    spark.createDataFrame(asked, "sample_no bigint, question string, gold_choice string, language string").write.parquet(str(tmp_path / "mcq_samples.parquet"))
    assert rows(reference.QUERIES["q_text_labels"](spark, str(tmp_path))) == [
        (1, "who sang at 5 30", "B", "english"), (2, "où est l école là-bas", "A", "french"), (3, "кто поёт", "C", "russian"), (4, "誰が歌う 二回", "D", None), (5, "누가 노래해", None, None), (6, None, "A", "greek"), (7, "", "A", "greek"),
    ]


def test_prior_of_tokens_at_any_place(spark):
    assert one(spark, " a : 1 ,b:3,, ", selection.parsed_prior) == {"A": 0.25, "B": 0.75}
    # the place of each token is a character at its end
    shares = [0.2, 0.01, 0.22, 0.03, 0.14, 0.05, 0.06, 0.07, 0.08, 0.09, 0.01, 0.04]
    raw = ",".join(f"{chr(97 + i)}:{x}" for i, x in enumerate(shares))
    assert one(spark, raw, selection.parsed_prior) == pytest.approx({chr(65 + i): x / sum(shares) for i, x in enumerate(shares)})


@pytest.mark.parametrize(
    "text,rewritten,n",
    [("between 3:34 and 7:39?", "between 00:05 and 00:15?", 2), ("at 2:00 or after 11:26", "at 00:05 or after 11:26", 1), ("1:30-2:00 at 5 min", "00:05-00:35 at 1min", 2), ("12,5 s to 20 s", "5.00s to 12s", 1), ("at 1:02:03", "at 1:02:03", 0), ("[22.12, 24.83] at 23", "[22.12, 24.83] at 6s", 2),
     ("0:05 s - 12:00", "0:05 s - 12:00", 1), ("0:05 s - 9:00", "0:5s - 09:00", 1), ("who sings?", "who sings?", 0), ("", "", 0), (None, None, 0)],
)
def test_times_of_a_cropped_recording(spark, text, rewritten, n):
    rows = spark.createDataFrame([(text, 600.0)], "q string, d double")
    got = pipelines.cropped_questions(rows, "q", "d", 5.0).select("q", F.size("windows")).first()
    assert tuple(got) == (rewritten, n)
