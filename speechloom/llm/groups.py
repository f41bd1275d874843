"""Splits that keep related records together.

Records and the entities they share form a bipartite graph. Each round every entity takes the smallest label of
its records and every record the smallest of its entities; records are then contracted to their labels and
entities left with one record drop out, so long chains shrink by a factor each round. Whole groups go to the
splits: the few large ones and buckets of small ones, largest first, each to the split where the counts of all
labels stay nearest to their targets.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from speechloom.llm.overlaps import file_of_path, file_of_recording
from speechloom.session import cut

#: Groups with at least this share of all records are placed one by one; the smaller ones in as many buckets a label.
PLACED = 1 / 2048


def smallest_labels(edges: DataFrame) -> DataFrame:
    """(record, label): the smallest record linked to each over any number of steps, of edges (record, entity).

    Null records and entities link nothing; repeated edges change nothing; an empty table gives no rows. Records
    of which no edge is left keep themselves as label. The state of each round is written to the shared
    checkpoint folder. A hot entity is aggregated before it is shuffled and joined back as one row.
    """
    edges = edges.toDF("record", "entity").where("record is not null and entity is not null").distinct()
    assigned = None
    while True:
        # an entity of one record links nothing
        shared = edges.groupBy("entity").agg(F.min("record").alias("low"), F.max("record").alias("high"))
        linked = edges.join(shared.where("low != high").select("entity", "low"), "entity")
        step = linked.groupBy("record").agg(F.min("low").alias("label"))
        edges = cut(linked.join(step, "record").select(F.col("label").alias("record"), "entity", F.col("record").alias("old")))
        step = edges.select("old", F.col("record").alias("label")).distinct()
        moved = step.where("old != label").limit(1).count()
        if not moved:
            break
        step = step.where("old != label")
        edges = edges.select("record", "entity").distinct()
        if assigned is None:
            assigned = step.withColumnRenamed("old", "record")
        else:
            chained = assigned.withColumnRenamed("label", "old").join(step, "old", "left").select("record", F.coalesce("label", "old").alias("label"))
            fresh = step.withColumnRenamed("old", "record").join(assigned.select("record"), "record", "left_anti")
            assigned = chained.unionByName(fresh)
        assigned = cut(assigned)
    if assigned is None:
        return edges.select("record", F.col("record").alias("label")).limit(0)
    return assigned


def recording_edges(recordings: DataFrame, segments: DataFrame) -> DataFrame:
    """(record, entity): each recording with its session and with the known speakers of its segments."""
    session = F.element_at(F.split(file_of_recording(F.col("rec_id")), "_"), 1)
    of_session = recordings.select(F.col("rec_id").alias("record"), F.concat(F.lit("session:"), session).alias("entity"))
    speaker = F.lower(F.trim("speaker"))
    spoken = segments.where(speaker.isNotNull() & ~speaker.isin("", "spk_unk")).select(F.col("rec_id").alias("record"), F.concat(F.lit("speaker:"), speaker).alias("entity")).distinct()
    spoken = spoken.join(recordings.select(F.col("rec_id").alias("record")), "record", "left_semi")
    return of_session.unionByName(spoken)


def recording_groups(recordings: DataFrame, segments: DataFrame) -> DataFrame:
    """(rec_id, group_rec_id) of every recording, a single one in a group of its own."""
    labels = smallest_labels(recording_edges(recordings, segments))
    known = recordings.where("rec_id is not null").select("rec_id").distinct()
    return known.join(labels.withColumnsRenamed({"record": "rec_id", "label": "group_rec_id"}), "rec_id", "left").withColumn("group_rec_id", F.coalesce("group_rec_id", "rec_id"))


def related_records(recordings: DataFrame, segments: DataFrame, samples: DataFrame) -> DataFrame:
    """(record_kind, record_key, group_rec_id, label) of every recording and sample.

    A sample belongs to the recording whose file its audio_path names, however spelled; samples of an unknown
    file belong together, a sample without a path stands alone: for those group_rec_id is "file:..." or "sample:...".
    """
    groups = cut(recording_groups(recordings, segments))
    by_file = groups.select(file_of_recording(F.col("rec_id")).alias("file"), "group_rec_id").groupBy("file").agg(F.min("group_rec_id").alias("group_rec_id"))
    label = lambda c: F.element_at(F.split(c, "__"), 1)
    one = groups.select(F.lit("recording").alias("record_kind"), F.col("rec_id").alias("record_key"), "group_rec_id", label("rec_id").alias("label"))
    rows = samples.where("sample_no is not null").select(F.col("sample_no").cast("string").alias("record_key"), file_of_path(F.col("audio_path")).alias("file"), F.lower(F.trim("language")).alias("spelled"))
    joined = rows.where("file is not null").join(by_file, "file", "left").withColumn("group_rec_id", F.coalesce("group_rec_id", F.concat(F.lit("file:"), "file")))
    alone = rows.where("file is null").withColumn("group_rec_id", F.concat(F.lit("sample:"), "record_key"))
    known = ~F.col("group_rec_id").rlike("^(file|sample):")
    two = joined.unionByName(alone).select(F.lit("sample").alias("record_kind"), "record_key", "group_rec_id", F.when(known, label("group_rec_id")).otherwise("unknown").alias("label"))
    return one.unionByName(two)


def group_members(recordings: DataFrame, segments: DataFrame, samples: DataFrame) -> DataFrame:
    """(record_kind, record_key, group_rec_id) of the groups of at least two recordings."""
    rows = cut(related_records(recordings, segments, samples))
    several = rows.where("record_kind = 'recording'").groupBy("group_rec_id").agg(F.count("*").alias("n")).where("n > 1")
    return rows.join(several, "group_rec_id", "left_semi").select("record_kind", "record_key", "group_rec_id")


def place(counts: np.ndarray, shares: np.ndarray) -> np.ndarray:
    """The split of each unit (row of counts by label): largest first, to the least squared deviation of all labels."""
    goal = shares[:, None] * counts.sum(axis=0)[None, :]
    total = goal.sum(axis=1)
    scale = np.maximum(counts.sum(axis=0), 1.0)
    have = np.zeros_like(goal)
    out = np.zeros(len(counts), np.int64)
    for i in np.argsort(-counts.sum(axis=1), kind="stable"):
        gap, size = goal - have, counts[i].sum()
        by_label = ((gap - counts[i]) ** 2 - gap**2) / scale
        overall = (total - have.sum(axis=1) - size) ** 2 - (total - have.sum(axis=1)) ** 2
        best = int(np.argmin(by_label.sum(axis=1) + overall / max(total.sum(), 1.0)))
        have[best] += counts[i]
        out[i] = best
    return out


def assign_splits(rows: DataFrame, targets: DataFrame, seed: int = 17) -> DataFrame:
    """rows with the column split: one of the targets for each whole group.

    rows: (..., group_rec_id, label). What comes to the driver is bounded by 1 / PLACED units for each label.
    A null label counts as a label of its own. Empty rows give none.
    """
    goal = sorted((r.split, float(r.target_share)) for r in targets.collect())
    sized = cut(rows.groupBy("group_rec_id", F.coalesce("label", F.lit("")).alias("label")).agg(F.count("*").alias("n")))
    total = sized.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    groups = sized.groupBy("group_rec_id").agg(F.sum("n").alias("size"), F.max_by("label", F.struct("n", "label")).alias("main"))
    bucket = F.pmod(F.xxhash64(F.lit(seed), "group_rec_id"), F.lit(round(1 / PLACED)))
    unit: Column = F.when(F.col("size") >= total * PLACED, F.concat(F.lit("group:"), "group_rec_id")).otherwise(F.concat(F.lit("bucket:"), "main", F.lit(":"), bucket))
    groups = cut(groups.select("group_rec_id", unit.alias("unit")))
    parts = sized.join(groups, "group_rec_id").groupBy("unit", "label").agg(F.sum("n").alias("n")).orderBy("unit", "label").collect()
    units, labels = sorted({r.unit for r in parts}), sorted({r.label for r in parts})
    if not units:
        return rows.withColumn("split", F.lit(None).cast("string")).limit(0)
    counts = np.zeros((len(units), len(labels)))
    at, of = {u: i for i, u in enumerate(units)}, {x: i for i, x in enumerate(labels)}
    for r in parts:
        counts[at[r.unit], of[r.label]] = r.n
    chosen = place(counts, np.array([s for _, s in goal]))
    table = rows.sparkSession.createDataFrame([(u, goal[int(k)][0]) for u, k in zip(units, chosen)], "unit string, split string")
    placed = groups.join(table, "unit").select("group_rec_id", "split")
    return rows.join(placed, "group_rec_id")


def split_report(assigned: DataFrame, targets: DataFrame) -> DataFrame:
    """(split, target_share, records, share) of the assigned rows."""
    n = assigned.groupBy("split").agg(F.count("*").alias("records"))
    total = assigned.agg(F.count("*").alias("total"))
    out = targets.select("split", "target_share").join(n, "split", "left").fillna(0, ["records"])
    # one row on the other side
    return out.join(F.broadcast(total)).select("split", "target_share", "records", F.round(F.col("records") / F.col("total"), 6).alias("share"))
