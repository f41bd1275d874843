import random

import numpy as np
import pyarrow as pa
import pytest

from speechloom.llm import balanced, groups, languages, leaks, lookalikes, overlaps, spam, tokens
from speechloom.session import cut

VOCABULARY = f"{tokens.FOLDER}/byte_bpe_50k.tiktoken"
BIGRAMS = {(ord(a), ord(b)): 50 for w in ("the door and a song", "дом и песня со мной", "вода") for a, b in zip(w, w[1:])}


# look-alikes


@pytest.mark.parametrize(
    "text,form",
    [("ｆｕｌｌ", "full"), ("éa", "éa"), ("a​b­c﻿", "abc"), ("a b　c", "a b c"), ("dооr", "door"), ("thе sоng", "the song"), ("вoда", "вода"), ("ﬁsh", "fish"), ("lɑmp", "lamp"),
     ("Селимож sings", "Селимож sings"), ("5 km и дом", "5 km и дом"), ("", ""), ("ﾈｺ", "ネコ"), ("дом и песня", "дом и песня"), ("naïve ß 日本 한국", "naïve ß 日本 한국")],
)
def test_canonical_text(text, form):
    assert lookalikes.canonical_text(text, lookalikes.Lattice(BIGRAMS)) == form
    assert lookalikes.canonical_text(form, lookalikes.Lattice(BIGRAMS)) == form


def test_canonical_column_keeps_rows(spark):
    df = spark.createDataFrame([(1, "ｘ"), (2, None), (3, ""), (3, ""), (4, "plain")], "k int, text string").selectExpr("*", "'c' as canonical")
    got = sorted((r.k, r.canonical) for r in lookalikes.canonical_column(df, "text").collect() if r.canonical is not None)
    assert got == [(1, "x"), (3, ""), (3, ""), (4, "plain")]
    assert [r.k for r in lookalikes.canonical_column(df, "text", only_changed=True).collect()] == [1]
    assert lookalikes.letter_bigrams(df.select("text").limit(0)) == {}


# tokens


def test_ids_equal_whole_encoding(spark):
    import tiktoken

    ranks = tokens.read_ranks(VOCABULARY)
    whole = tiktoken.Encoding("whole", pat_str=tokens.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(1)
    alphabet = ["the", " ", "  ", "\n", "\t", "é", "日本", "　", " ", "12", "'ll", "<|endoftext|>", "!?", "😀", "\x07", "a" * 30]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 60))) for _ in range(300)] + ["", "ab" * 5000 + "  \n" + "é " * 3000]
    encoder = tokens.Encoder(ranks)
    assert encoder.many(pa.array(texts)).to_pylist() == [whole.encode_ordinary(t) for t in texts]
    assert encoder.many(pa.array([None, "a"])[1:]).to_pylist() == [whole.encode_ordinary("a")]
    assert len(encoder.one(" " * 300_000 + "x")) > 1  # beyond what the pattern's own engine can match at once
    df = spark.createDataFrame([(1, "a b"), (2, None), (3, ""), (1, "a b")], "doc_id bigint, text string").selectExpr("*", "1 as ids")
    got = sorted((r.doc_id, list(r.ids)) for r in tokens.token_ids(df).collect())
    assert got == [(1, whole.encode_ordinary("a b"))] * 2 + [(2, []), (3, [])]


# balanced samples


def fly(units, rng):
    """A flight of (category, p) units."""
    flight = balanced.Flight()
    for i, (category, p) in enumerate(units):
        flight.meet(("f", category), (i, category), p, rng.random())
    return flight


def test_flight_keeps_totals():
    rng = random.Random(2)
    units = [(c, 0.3) for c in "ab" for _ in range(100)] + [("c", 0.35)] * 3 + [("d", 1.0), ("e", 0.0)]
    flight = fly(units, rng)
    drawn = lambda c: sum(u[1] == c for u in flight.chosen)
    assert set(flight.open) <= {("f", c) for c in "abc"}
    for c, total in (("a", 30), ("b", 30), ("c", 1.05)):
        assert drawn(c) + flight.open.get(("f", c), (0, 0.0))[1] == pytest.approx(total)
    assert drawn("d") == 1 and drawn("e") == 0
    landed = fly([(c, 0.4) for c in "abcde"], rng)
    landed.land(lambda slot: slot[0], lambda unit, k: rng.random())
    assert len(landed.chosen) == 2 and not landed.open


def test_draws_are_above_and_below_the_target_in_proportion():
    # partitions of 50 to 63 records fly alone, what they leave is merged and landed
    above = below = 0
    shares = np.zeros(63)
    for seed in range(2000):
        rng = random.Random(seed)
        sizes = [50, 52, 55, 57, 59, 60, 61, 63]
        chosen, rest = 0, []
        for n in sizes:
            flight = fly([("a", 0.2)] * n, rng)
            chosen += len(flight.chosen)
            rest += [p for _, p in flight.open.values()]
            if n == 63:
                shares += np.bincount([u[0] for u in flight.chosen], minlength=63)
        last = fly([("a", p) for p in rest], rng)
        last.land(lambda slot: slot[0], lambda unit, k: rng.random())
        chosen += len(last.chosen)
        above, below = above + (chosen > 91.4), below + (chosen < 91.4)
        assert chosen in (91, 92)
    # the target is 91.4
    assert abs(above / 2000 - 0.4) < 0.05
    # the last of a partition are left open and decided after the merge
    assert abs(shares[:60] / 2000 - 0.2).max() < 0.06


def test_draw_and_report(spark):
    records = spark.createDataFrame([("f", f"{c}{i}", c) for c, n in (("a", 600), ("b", 100), ("c", 3)) for i in range(n)] + [("f", f"n{i}", None) for i in range(297)], "target_field string, record_key string, category string")
    targets = spark.createDataFrame([("f", "a", 0.5, 5), ("f", "b", 0.3, 5), ("f", "c", 0.1, 5), ("f", "z", 0.1, 5), ("g", "a", 1.0, 1)], "target_field string, category string, target_share double, min_rows bigint")
    sample, report = balanced.draw(records.repartition(7), targets)
    got = {(r.target_field, r.category): (r.drawn, r.can_be_met) for r in report.collect()}
    assert got == {("f", "a"): (100, True), ("f", "b"): (60, True), ("f", "c"): (3, False), ("f", "z"): (0, False), ("g", "a"): (0, False)}
    assert sample.distinct().count() == sample.count() == 163
    empty, report = balanced.draw(records.limit(0), targets)
    assert empty.count() == 0 and report.where("can_be_met").count() == 0


# groups


def components(edges):
    label = {r: r for r, _ in edges}
    changed = True
    while changed:
        changed = False
        low = {}
        for r, e in edges:
            low[e] = min(low.get(e, label[r]), label[r])
        for r, e in edges:
            if low[e] < label[r]:
                label[r], changed = low[e], True
    return label


def test_labels_equal_brute_force(spark):
    rng = random.Random(3)
    edges = [(f"r{rng.randrange(150):03}", f"e{rng.randrange(160)}") for _ in range(260)] + [(f"s{i:03}", f"c{i // 2}") for i in range(60)] + [(f"s{i:03}", f"d{(i + 1) // 2}") for i in range(60)]
    rng.shuffle(edges)
    frame = spark.createDataFrame(edges + [(None, "e1"), ("r1", None)] + edges[:5], "rec string, ent string")
    got = {r.record: r.label for r in groups.smallest_labels(frame).collect()}
    assert {k: got.get(k, k) for k in components(edges)} == components(edges)
    assert groups.smallest_labels(frame.limit(0)).count() == 0


def test_splits_keep_groups(spark):
    rows = spark.createDataFrame([(str(i), f"g{i % 90}" if i % 3 else f"big{i % 4}", "x" if i % 2 else None) for i in range(3000)], "record_key string, group_rec_id string, label string")
    targets = spark.createDataFrame([("train", 0.8), ("validation", 0.1), ("test", 0.1)], "split string, target_share double")
    out = cut(groups.assign_splits(rows, targets))
    assert out.count() == 3000
    assert out.select("group_rec_id", "split").distinct().count() == rows.select("group_rec_id").distinct().count()
    assert {r.split: round(r.share, 1) for r in groups.split_report(out, targets).collect()} == {"train": 0.8, "validation": 0.1, "test": 0.1}
    assert groups.assign_splits(rows.limit(0), targets).count() == 0


# overlaps


def test_slips():
    assert overlaps.slips("about", "aobut") == 1 and overlaps.slips("between", "bween") == 2 and overlaps.slips("a", "abcd") == 3
    assert overlaps.mistyped("galusa", "gaalusa") and overlaps.mistyped("doruda", "dourda") and not overlaps.mistyped("thaleth", "thaleda")


def test_overlaps_of_questions(spark):
    names = ["Thalelda", "Marinor", "Keluska", "Velorric", "Selinmo", "Doruwen"]
    ask = "What does {} say about the gardener at {}?"
    rows, no = [], 0
    for i in range(300):
        no += 1
        rows.append((no, "train", f"corpus/audio/English/x/00000{i % 40:02}_001_room.wav", ask.format(names[i % 6], f"{i % 9}:{i % 60:02}")))
    base = rows[6]
    tests = [base[3].upper().replace("ABOUT", "AOBUT"), "Please listen: " + base[3], base[3].replace(":06", ":07"), base[3].replace(names[0], names[1]), base[3] + " And why is that so?", base[3].replace("gardener", "gаrdеner") + " ", None, ""]
    for j, t in enumerate(tests):
        rows.append((1000 + j, "test", "file:///x/English%2Fx/0000006_001_ROOM.mp3?rev=1", t))
    rows += [(2000, "dev", None, base[3]), (2001, "dev", "corpus/none_1_room.wav", base[3])]
    samples = spark.createDataFrame([(*r, "s") for r in rows], "sample_no bigint, split string, audio_path string, question string, source string")
    recordings = spark.createDataFrame([(f"English__x__00000{i:02}_001_room",) for i in range(40)], "rec_id string")
    found = {(r.eval_no, r.train_no) for r in overlaps.split_overlaps(samples, recordings).collect()}
    assert found == {(1000, 7), (1001, 7), (1005, 7)}
    assert overlaps.split_overlaps(samples.limit(0), recordings).count() == 0


# leaks


def test_every_shared_run_is_found(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    items = [" ".join(rng.choice(words) for _ in range(45)) for _ in range(12)]
    docs, expected = [], set()
    for d in range(200):
        text = [rng.choice(words) for _ in range(60)]
        item, n = rng.randrange(12), rng.choice([8, 13, 14, 15, 16, 30])
        at = rng.randrange(45 - n + 1)
        text[20:20] = ["filler", *items[item].split()[at : at + n], "stop"]
        docs.append((d, " \n".join(text).upper().replace("W1", "Ｗ1")))
        if n >= 15:
            expected.add((d, item))
    docs += [(500, None), (501, ""), (None, items[0]), (502, items[1]), (502, items[1])]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr("*", "1 as item", "2 as key")
    evals = spark.createDataFrame(list(enumerate(items)) + [(77, None)], "item_id bigint, item_text string")
    found = [(r.doc_id, r.item_id) for r in leaks.leaked_items(frame, evals).collect()]
    assert sorted(found) == sorted(expected | {(502, 1)})
    # shuffled instead of broadcast, with every fingerprint of two documents spread
    spread = [(r.doc_id, r.item_id) for r in leaks.leaked_items(frame, evals, broadcast_rows=0, hot_rows=1).collect()]
    assert sorted(spread) == sorted(found)
    assert leaks.leaked_items(frame, evals.limit(0)).count() == 0


def test_covered_run():
    at = lambda text: np.array([hash(tuple(text[i : i + 3])) for i in range(len(text) - 2)])
    assert leaks.covered_run(at("x a b c d y a b c".split()), at("a b c d".split()), 3) == 4
    assert leaks.covered_run(at("a b c".split()), at("x a b c".split()), 3) == 3
    assert leaks.covered_run(at("x a b".split()), at("a b c".split()), 3) == 0
    assert leaks.covered_run(np.empty(0), at("a b c".split()), 3) == 0
    assert len(leaks.grams(np.arange(2, dtype=np.uint64), 3)) == 0


def test_winnowing_guarantee():
    rng = np.random.default_rng(5)
    a = rng.integers(0, 1 << 60, 15).astype(np.uint64)
    b = np.concatenate([rng.integers(0, 1 << 60, 9).astype(np.uint64), a, rng.integers(0, 1 << 60, 7).astype(np.uint64)])
    kept = [set(leaks.winnow(x, np.array([0, len(x)]), leaks.K, leaks.WINDOW)[1].tolist()) for x in (a, b)]
    assert kept[0] & kept[1]


# languages


SENTENCES = {
    "en": ["the gardener hides the green umbrella before lunch", "our neighbour has lost the blue folder since last winter", "the choir is looking for a better recipe on thursday"],
    "fr": ["le facteur cache le parapluie vert avant le déjeuner", "notre équipe cherche un logement près du marché", "la voisine mesure une valise vide depuis hier soir"],
    "ru": ["садовник прячет зелёный зонт перед обедом", "наша команда вспоминает пропавшую страницу", "соседка несёт пустой чемодан до конца месяца"],
}


def test_languages_and_mixed_texts(spark):
    rng = random.Random(6)
    segments = []
    for i in range(600):
        code = rng.choice(list(SENTENCES))
        segments.append((f"u{i}", "English__x__0_1_room", rng.choice(SENTENCES[code]), code if rng.random() < 0.9 else "fr"))
    odd = [("m", SENTENCES["en"][0] + ". " + SENTENCES["fr"][1], "en"), ("w", SENTENCES["ru"][1], "en"), ("n", SENTENCES["fr"][0], None), ("x", SENTENCES["en"][1], "klingon"), ("e", "", None), ("z", None, "en"), ("s", "le lit", "en")]
    segments += [(k, "English__x__0_1_room", t, x) for k, t, x in odd]
    seg = spark.createDataFrame(segments, "utt_id string, rec_id string, text string, language string")
    samples = spark.createDataFrame([], "sample_no bigint, audio_path string, question string, language string")
    codes = spark.createDataFrame([(c, c) for c in SENTENCES], "label string, code string")
    rows = cut(languages.text_languages(languages.language_rows(seg, samples, codes)))
    found = {(r.record_key, r.language) for r in languages.label_cases(rows).collect()}
    assert {x for x in found if x[0] in "mwnxezs"} == {("m", "en"), ("m", "fr"), ("w", "ru"), ("n", "fr"), ("x", "en")}
    right = {f"u{i}": c for i in range(600) for c in SENTENCES if segments[i][2] in SENTENCES[c]}
    assert all(r.language == right[r.record_key] and 0 <= r.confidence <= 1 for r in rows.where("record_key like 'u%'").collect())
    assert languages.text_languages(languages.language_rows(seg.limit(0), samples, codes)).count() == 0


# spam


def test_spam_pages(spark):
    rng = random.Random(7)
    who, what, when = ["the nurse", "my cousin", "the choir", "our neighbour"], ["hides the red candles", "draws a map", "cleans the bridge", "orders two tickets"], ["before lunch", "at night", "every morning", "on Thursday evening"]
    said = lambda: f"{rng.choice(who)} {rng.choice(what)} {rng.choice(when)}."
    good = [" ".join(said() for _ in range(8)) + ("\nAna: " + "no " * (3 + i % 4) if i % 5 == 0 else "") for i in range(300)]
    bad = ["cheap phone cheap phone " * 20, "buy " * 200, "buy buy buy buy buy\nbuy buy buy buy", "cheap shoes online store\n" * 80, "\n".join(f"https://shop{i}.example/p/{i}" for i in range(15)), " ".join(f"#red_candles{i}" for i in range(20)), "\n".join(f"phone XL - SKU {i} - 19.90 - in stock" for i in range(9)),
           said() + "\n" + " ".join(f"phone {m} case {m} phone deal" for m in ["pro", "mini", "XL", "pro", "mini", "XL"] * 4)]
    fine = ["", "   ", None, "hello", good[0] + " see https://a.example #tag", "Ana: " + "no " * 40]
    docs = [(i, t) for i, t in enumerate(good)] + [(1000 + i, t) for i, t in enumerate(bad)] + [(2000 + i, t) for i, t in enumerate(fine)] + [(None, bad[0])]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr("*", "1 as n", "2 as pair", "3 as words")
    shares = {r.doc_id: r.spam_share for r in spam.spam_shares(frame).collect()}
    assert len(shares) == len(docs) - 1
    found = {k for k, v in shares.items() if v >= spam.THRESHOLD}
    assert found == {1000 + i for i in range(len(bad))}
    assert spam.spam_shares(frame.limit(0)).count() == 0


def test_rare_words_are_counted(spark, monkeypatch):
    # the word 'echo' is rarer than the least share, yet expected beside 'the' more than once
    rng = random.Random(8)
    said = [f"the singer{x} hums{x}" for x in "abcdefghijklmnopqrst"]
    good = [" ".join(rng.choice(said) for _ in range(9)) + "." + (" some echo." if i % 4 == 0 else "") for i in range(400)]
    odd = " ".join(["the echo", *said[:3]])
    docs = [*enumerate(good), (1000, odd)]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")

    def shares(word_share, pair_share):
        monkeypatch.setattr(spam, "WORD_SHARE", word_share)
        monkeypatch.setattr(spam, "PAIR_SHARE", pair_share)
        return {r.doc_id: r.spam_share for r in spam.spam_shares(frame).collect()}

    whole = shares(0.0, 0.0)
    assert whole[1000] == round(3 / 11, 6)
    assert shares(0.02, 0.0) == shares(0.02, 0.001) == shares(0.5, 0.5) == whole


def test_copies_of_keyword_lines(spark):
    rng = random.Random(9)
    who, what, when = ["the nurse", "my cousin", "the choir", "our neighbour"], ["hides the red candles", "draws a map", "cleans the bridge", "orders two tickets"], ["before lunch", "at night", "every morning", "on thursday evening"]
    said = lambda: f"{rng.choice(who)} {rng.choice(what)} {rng.choice(when)}."
    good = [" ".join(said() for _ in range(8)) for _ in range(300)]
    line = "cheap microphone best microphone buy microphone online microphone store"
    bad = ["mic deals mic deals\n" * 200, f"{line}\n" * 200, f"{line}. " * 90, said() + "\n" + "lamp shop lamp deals\n" * 50]
    fine = [f"{said()} " * 40, "\n".join([*good[0].split(". "), *["our neighbour draws a map at night"] * 30]), good[1] + "\n" + "Velor asks whether Zilasa sings\n" * 4]
    docs = [*enumerate(good), *enumerate(bad, 1000), *enumerate(fine, 2000)]
    shares = {r.doc_id: r.spam_share for r in spam.spam_shares(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    assert {k for k, v in shares.items() if v >= spam.THRESHOLD} == {1000, 1001, 1002, 1003}
    assert shares[1000] == shares[1001] == 1


def test_host_rates_of_every_session(spark):
    # the address x has 19 of 20 labels b; session s1 there one label a, s2 none; address y has no label
    labelled = [("s0", "x", "b")] * 19 + [("s1", "x", "a"), ("s2", "x", None), ("s3", "y", None), (None, "x", None), (None, None, None), ("s4", None, "a"), ("s4", None, None)]
    rows = spark.createDataFrame(labelled, "session string, address string, label_code string")
    got = {(r.session, r.address): list(r.rates) for r in languages.host_rates(rows, ["a", "b", "c"]).collect()}
    base = {"a": 2 / 21, "b": 19 / 21, "c": 0}
    at_x = {"a": (1 + 10 * base["a"]) / 30, "b": (19 + 10 * base["b"]) / 30, "c": 0}
    smooth = lambda s, n, over: pytest.approx([(s.get(c, 0) + 5 * over[c]) / (n + 5) for c in "abc"])
    assert len(got) == 7
    assert got["s0", "x"] == smooth({"b": 19}, 19, at_x) and got["s1", "x"] == smooth({"a": 1}, 1, at_x)
    assert got["s2", "x"] == got[None, "x"] == smooth({}, 0, at_x)
    assert got["s3", "y"] == got[None, None] == smooth({}, 0, base)
    assert got["s4", None] == smooth({"a": 1}, 1, base)


def test_ngrams_of_long_runs():
    grams = np.zeros((languages.BUCKETS, 2), np.float32)
    grams[languages.ngrams("zation")] = [0, -1]
    model = languages.Model(["en", "fr"], {}, grams, {})
    told = {k: model.word("q" * k + "zation")[0].tolist() for k in (5, 60, 6000)}
    assert told[5] == told[60] == told[6000] == [0, -3]
