import json
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from speechloom.operators import intervals, nested


def brute(spans):
    """Periods of one entity by sorting."""
    out = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 500), st.integers(1, 90)), min_size=1, max_size=30))
def test_dyadic_union_equals_sorting(spans):
    lo = np.array([a for a, _ in spans], np.int64)
    hi = lo + np.array([n for _, n in spans], np.int64)
    a, b = intervals.dyadic_union(lo, hi, 10)
    assert list(zip(a.tolist(), b.tolist())) == brute(zip(lo.tolist(), hi.tolist()))


def test_blocks_are_canonical():
    levels = intervals.canonical_blocks(np.array([3]), np.array([11]), 4)
    assert [x.tolist() for x in levels] == [[3, 10], [4], [1], [], []] or sum((x.size << k) for k, x in enumerate(levels)) == 8
    merged = intervals.merge_siblings([np.array([4, 5]), np.array([3]), np.empty(0, np.int64)])
    assert [x.tolist() for x in merged] == [[], [], [1]]


def test_periods_and_gaps_over_cells(spark, rows):
    unit = 1 << intervals.CELL_BITS
    spans = [("a", 0, 10), ("a", 10, 20), ("a", 5, 7), ("a", 30, 40), ("a", 30, 40), ("b", unit - 5, 3 * unit + 5), ("b", unit + 7, unit + 9), ("b", 3 * unit + 5, 3 * unit + 6),
             ("b", 3 * unit + 9, 3 * unit + 10), ("c", -5, -1), ("c", 3, 3), (None, 1, 2), ("c", None, 4), ("d", 0, 40 * unit), ("d", 2 * unit, 3 * unit), ("d", 41 * unit, 41 * unit + 1)]
    df = spark.createDataFrame(spans, "k string, lo bigint, hi bigint").selectExpr("k", "lo", "hi", "1 as entity", "'x' as runs")
    expected = []
    for k in "abcd":
        p = brute([(a, b) for e, a, b in spans if e == k and a is not None and b > a])
        expected += [(k, "period", a, b) for a, b in p] + [(k, "gap", x[1], y[0]) for x, y in zip(p, p[1:])]
    assert rows(intervals.periods_and_gaps(df, "k", "lo", "hi")) == sorted(expected, key=repr)
    short = intervals.periods_and_gaps(df, "k", "lo", "hi", 5).where("kind = 'gap'")
    assert rows(short) == [("b", "gap", 3 * unit + 6, 3 * unit + 9)]
    assert rows(intervals.periods_and_gaps(df.limit(0), "k", "lo", "hi")) == []


def test_periods_across_stretches(spark, rows):
    rng = random.Random(1)
    far = 1 << (intervals.CELL_BITS + intervals.STRETCH_BITS)
    spans = []
    for k in "abc":
        for _ in range(60):
            a = rng.randrange(6 * far)
            spans.append((k, a, a + rng.choice([5, 1 << 14, 1 << 18, far // 3, far + 9])))
    spans += [("d", i * far, i * far + (far if i % 2 else 7)) for i in range(5)]
    df = spark.createDataFrame(spans, "k string, lo bigint, hi bigint")
    expected = []
    for k in "abcd":
        p = brute([(a, b) for e, a, b in spans if e == k])
        expected += [(k, "period", a, b) for a, b in p] + [(k, "gap", x[1], y[0]) for x, y in zip(p, p[1:])]
    assert rows(intervals.periods_and_gaps(df, "k", "lo", "hi")) == sorted(expected, key=repr)


def test_segments_with_dirty_bounds(spark, rows):
    inf, nan = float("inf"), float("nan")
    seg = spark.createDataFrame([("r", 1.0, -1.0), ("r", 0.5, 0.7), ("r", nan, 2.0), ("r", 1.0, inf), ("r", 9.0, 8.0), ("r", None, 1.0), ("r", 1.0, None), ("q", 2.0, -1.0), ("r", 1e300, 2e300)], "rec_id string, start_sec double, end_sec double")
    rec = spark.createDataFrame([("r", 3.0), ("q", None)], "rec_id string, duration_sec double")
    expected = [("r", "gap", 70, 100), ("r", "period", 50, 70), ("r", "period", 100, 300)]
    assert rows(intervals.speech_periods(seg, rec)) == sorted(expected, key=repr)


def test_option_labels_of_all_layouts(spark, rows):
    q = {"question_stem": "s", "options": [{"label": " a", "text": "x"}, {"text": "y"}, {"label": "A", "text": "z"}]}
    lines = [
        json.dumps({"path": "p", "questions": [q, None, {"question_stem": "t", "options": []}]}),
        json.dumps({"questions": json.dumps([q])}),
        json.dumps({"batch": {"n": 1}, "item": {"questions": {"question_stem": "u", "options": {"b": "1", "A": None}}}}),
        json.dumps({"sections": [{"questions": [q, None]}, {"questions": []}, {"questions": [{"options": ["k", "l"]}]}]}),
        json.dumps({"session_id": "s", "question_stem": "v", "options": [["C", "w"], ["", "d"]]}),
        '{"questions": [', "", "   ", None, "[1, 2]", '{"questions": null}', '"text"', '{"question_stem": "\\ud83d", "options": null}',
    ]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "line_no bigint, jsonl string").selectExpr("*", "1 as node", "'x' as doc")
    nodes = nested.json_nodes(df, "line_no", "jsonl")
    assert rows(nested.option_labels(nodes)) == sorted(
        [(0, 0, "A"), (0, 0, "B"), (0, 2, ""), (1, 0, "A"), (1, 0, "B"), (2, 0, "A"), (2, 0, "B"), (3, 0, "A"), (3, 0, "B"), (3, 2, "A"), (3, 2, "B"), (4, 0, "C"), (4, 0, "B"), (12, 0, "")], key=repr
    )
    options, questions, records = nested.jsonl_options(nodes), nested.jsonl_questions(nodes), nested.jsonl_records(nodes)
    assert options.join(questions, ["line_no", "question_node"], "left_anti").count() == 0
    assert questions.join(records, ["line_no", "record_node"], "left_anti").count() == 0
    assert rows(nested.option_labels(nested.json_nodes(df.limit(0), "line_no", "jsonl"))) == []


def test_parent_is_the_truncated_label():
    text = json.dumps({"a": [{"b": {"c": 1}}, [2]]})
    labels = {n[0] for n in nested.shred(text)}
    assert labels == {"0", "0.0", "0.0.0", "0.0.0.0", "0.0.1"}
    assert all("." not in x or x.rpartition(".")[0] in labels for x in labels)
