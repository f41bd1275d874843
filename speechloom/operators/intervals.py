"""Continuous periods and gaps of overlapping integer intervals, by canonical dyadic blocks.

The time axis of every entity is cut into cells of 2**CELL_BITS units. An interval is split into
its fragments at its two end cells and a range of whole cells between. Fragments are decomposed
into canonical dyadic blocks, blocks below a present ancestor are dropped, sibling pairs merge
upward, and adjacent blocks coalesce into runs: once per batch before the shuffle (so a hot cell
shrinks on the map side) and once per cell after it. A cell holds at most 2**(CELL_BITS - 1) runs,
so no task gathers an unbounded group, however skewed the entities are. Only the first and last run of
each cell meet other cells: those of a stretch of cells in one window, and one row for each stretch of the entity.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from speechloom.session import cut

CELL_BITS = 16
#: Cells of one stretch: the pieces between cells are ordered by stretch.
STRETCH_BITS = 10
#: A bound beyond this many units counts as not finite: sums and products of it stay exact.
LARGEST = 1 << 52
#: Levels a whole-cell range can take: 2 * LARGEST units are fewer than 2**(CELL_BITS + MANY) units.
MANY = 54 - CELL_BITS


def canonical_blocks(lo: np.ndarray, hi: np.ndarray, top: int) -> list[np.ndarray]:
    """Block indices by level 0..top whose disjoint union is [lo, hi), for each interval the fewest."""
    lo, hi = lo.copy(), hi.copy()
    levels = []
    for k in range(top + 1):
        live = lo < hi
        lo, hi = lo[live], hi[live]
        if k == top:
            rest = hi - lo
            first = np.repeat(lo, rest)
            levels.append(first + np.arange(len(first)) - np.repeat(np.cumsum(rest) - rest, rest))
            break
        left, right = (lo & 1) == 1, (hi & 1) == 1
        levels.append(np.concatenate([lo[left], hi[right] - 1]))
        lo, hi = (lo + 1) >> 1, hi >> 1
    return levels


def drop_covered(levels: list[np.ndarray]) -> list[np.ndarray]:
    """Drop repeated blocks and those with a present ancestor.

    Blocks nest or are disjoint, so in order of start and falling size a block lies under an earlier one
    exactly if it ends no later than all before it.
    """
    level = np.concatenate([np.full(len(x), k, np.int64) for k, x in enumerate(levels)])
    start = np.concatenate([x << k for k, x in enumerate(levels)])
    order = np.lexsort((-level, start))
    level, start = level[order], start[order]
    end = start + (np.int64(1) << level)
    keep = np.ones(len(end), bool)
    keep[1:] = end[1:] > np.maximum.accumulate(end)[:-1]
    level, start = level[keep], start[keep]
    return [start[level == k] >> k for k in range(len(levels))]


def merge_siblings(levels: list[np.ndarray]) -> list[np.ndarray]:
    """Replace both children of a parent by the parent, from the lowest level upward."""
    levels = [np.sort(x) for x in levels]
    for k in range(len(levels) - 1):
        x = levels[k]
        if len(x) < 2:
            continue
        pair = np.flatnonzero(((x[:-1] & 1) == 0) & (x[1:] == x[:-1] + 1))
        if len(pair):
            levels[k + 1] = np.sort(np.concatenate([levels[k + 1], x[pair] >> 1]))
            levels[k] = np.delete(x, np.concatenate([pair, pair + 1]))
    return levels


def coalesce_blocks(levels: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs [lo, hi) of disjoint blocks."""
    lo = np.concatenate([x << k for k, x in enumerate(levels)])
    size = np.concatenate([np.full(len(x), 1 << k, np.int64) for k, x in enumerate(levels)])
    order = np.argsort(lo, kind="stable")
    lo, hi = lo[order], (lo + size)[order]
    if not len(lo):
        return lo, hi
    new = np.r_[True, lo[1:] != hi[:-1]]
    last = np.r_[new[1:], True]
    return lo[new], hi[last]


def dyadic_union(lo: np.ndarray, hi: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """The union of [lo, hi) as maximal runs."""
    return coalesce_blocks(merge_siblings(drop_covered(canonical_blocks(lo, hi, top))))


def _runs_of_cells(entity: pa.Array, cell: np.ndarray, lo: np.ndarray, hi: np.ndarray):
    """Merge fragments by (entity, cell). Returns the first row of each group, its runs and their group."""
    codes = entity.dictionary_encode()
    code = np.asarray(codes.indices.to_numpy(zero_copy_only=False), np.int64)
    order = np.lexsort((cell, code))
    new = np.r_[True, (np.diff(code[order]) != 0) | (np.diff(cell[order]) != 0)]
    first, group = order[new], np.empty(len(order), np.int64)
    group[order] = np.cumsum(new) - 1
    # each group has its own stretch of twice a cell, so blocks of two groups are never siblings
    base = group << (CELL_BITS + 1)
    start, end = dyadic_union(base + lo, base + hi, CELL_BITS)
    of = start >> (CELL_BITS + 1)
    return first, of, start - (of << (CELL_BITS + 1)), end - (of << (CELL_BITS + 1))


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Before the shuffle: fragments of a batch to the runs of its cells."""
    for b in batches:
        if not b.num_rows:
            continue
        cell, lo, hi = (np.asarray(b.column(i)) for i in (1, 2, 3))
        first, of, start, end = _runs_of_cells(b.column(0), cell, lo, hi)
        at = first[of]
        yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), pa.array(cell[at]), pa.array(start), pa.array(end)], ["entity", "cell", "lo", "hi"])


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """After the shuffle, sorted by entity and cell: a row for each cell with the array of its runs."""
    kind = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))

    def rows(entity, cell, first, of, start, end):
        n = np.bincount(of, minlength=len(first))
        order = np.lexsort((start, of))
        at = cell[first][of] << CELL_BITS
        runs = pa.StructArray.from_arrays([pa.array((at + start)[order]), pa.array((at + end)[order])], ["lo", "hi"])
        lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)].astype(np.int32)), runs).cast(kind)
        return pa.RecordBatch.from_arrays([entity.take(pa.array(first)), pa.array(cell[first]), lists], ["entity", "cell", "runs"])

    held = None  # runs of the last cell of the batches so far, which the next batch may continue
    for b in batches:
        if not b.num_rows:
            continue
        entity, cell, lo, hi = b.column(0), *(np.asarray(b.column(i)) for i in (1, 2, 3))
        if held is not None:
            entity = pa.concat_arrays([held[0], entity])
            cell, lo, hi = (np.concatenate([x, y]) for x, y in zip(held[1:], (cell, lo, hi)))
        first, of, start, end = _runs_of_cells(entity, cell, lo, hi)
        tail = len(entity) - 1
        names = entity.take(pa.array(first))
        same = np.asarray(pa.compute.equal(names, entity[tail]).to_numpy(zero_copy_only=False), bool) & (cell[first] == cell[tail])
        keep = same[of]
        held = (pa.array([entity[tail].as_py()] * int(keep.sum()), entity.type), np.full(int(keep.sum()), cell[tail]), start[keep], end[keep])
        done = np.flatnonzero(~same)
        if len(done):
            renumber = np.full(len(first), -1)
            renumber[done] = np.arange(len(done))
            yield rows(entity, cell, first[done], renumber[of[~keep]], start[~keep], end[~keep])
    if held is not None:
        yield rows(held[0], held[1], np.zeros(1, np.int64), np.zeros(len(held[2]), np.int64), held[2], held[3])


def _range_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole-cell ranges to canonical blocks (level in cells), those of an entity's batch without covered ones."""
    for b in batches:
        lo, hi = np.asarray(b.column(1)), np.asarray(b.column(2))
        codes = b.column(0).dictionary_encode()
        code = np.asarray(codes.indices)
        order = np.argsort(code, kind="stable")
        entity, level, block = [], [], []
        for own in np.split(order, np.flatnonzero(np.diff(code[order])) + 1) if b.num_rows else ():
            levels = drop_covered(canonical_blocks(lo[own], hi[own], MANY))
            size = [len(x) for x in levels]
            entity.append(np.full(sum(size), code[own[0]]))
            level.append(np.repeat(np.arange(len(levels)), size))
            block.extend(levels)
        if entity:
            yield pa.RecordBatch.from_arrays([codes.dictionary.take(pa.array(np.concatenate(entity))), pa.array(np.concatenate(level)), pa.array(np.concatenate(block))], ["entity", "level", "block"])


def centiseconds(seconds: Column) -> Column:
    """Whole centiseconds; null for null, not finite or beyond LARGEST."""
    x = F.round(seconds * 100)
    return F.when(~F.isnan(x) & (F.abs(x) < F.lit(float(LARGEST))), x).cast("bigint")


def half_even_centiseconds(seconds: Column) -> Column:
    """Whole centiseconds, halves to the even one; null for null, not finite or beyond LARGEST."""
    x = F.bround(seconds * 100)
    return F.when(~F.isnan(x) & (F.abs(x) < F.lit(float(LARGEST))), x).cast("bigint")


def periods_and_gaps(intervals: DataFrame, entity: str, lo: str, hi: str, longest_gap: int | None = None) -> DataFrame:
    """Merge integer intervals [lo, hi) of each entity into continuous periods and list the gaps between.

    Returns (entity, kind, lo, hi), kind `period` or `gap`. Touching intervals share a period. A gap longer
    than longest_gap is left out. Rows with a null entity or bound, or hi <= lo, are ignored; repeated rows
    and ties change nothing; an empty table gives no rows; other columns are not read.
    """
    e, a, b = F.col(entity).cast("string"), F.col(lo).cast("bigint"), F.col(hi).cast("bigint")
    rows = intervals.select(e.alias("entity"), a.alias("lo"), b.alias("hi")).where("entity is not null and lo < hi")
    unit = 1 << CELL_BITS
    first, last = F.shiftright("lo", CELL_BITS), F.shiftright(F.col("hi") - 1, CELL_BITS)
    rows = rows.withColumns({"first": first, "last": last})

    def part(cell, lo, hi):
        return F.struct(cell.alias("cell"), lo.cast("bigint").alias("lo"), hi.cast("bigint").alias("hi"))

    start, end = F.col("lo") - F.col("first") * unit, F.col("hi") - F.col("last") * unit
    one = F.col("first") == F.col("last")
    parts = F.when(one, F.array(part(F.col("first"), start, end))).otherwise(F.array(part(F.col("first"), start, F.lit(unit)), part(F.col("last"), F.lit(0), end)))
    shape = "entity string, cell bigint, lo bigint, hi bigint"
    cells = rows.select("entity", F.inline(parts)).mapInArrow(_combine, shape).repartition("entity", "cell").sortWithinPartitions("entity", "cell")
    cells = cut(cells.mapInArrow(_finish, "entity string, cell bigint, runs array<struct<lo:bigint,hi:bigint>>"))

    # whole-cell ranges: at most one row for each cell they start in
    ranges = rows.where("last > first + 1").select("entity", (F.col("first") + 1).alias("lo"), F.col("last").alias("hi")).groupBy("entity", "lo").agg(F.max("hi").alias("hi"))
    blocks = cut(ranges.mapInArrow(_range_blocks, "entity string, level bigint, block bigint").distinct())
    # at most MANY + 1 levels, and only those that some range has
    levels = sorted(r.level for r in blocks.select("level").distinct().collect())
    if levels:
        ancestors = cells.select("entity", "cell", F.explode(F.array(*(F.lit(k) for k in levels))).alias("level")).withColumns({"block": F.expr("shiftright(cell, cast(level as int))"), "level": F.col("level").cast("bigint")})
        covered = ancestors.join(blocks, ["entity", "level", "block"], "left_semi").select("entity", "cell")
        cells = cells.join(covered, ["entity", "cell"], "left_anti")

    run, n = F.col("runs"), F.size("runs")
    inside = F.concat(
        F.transform(F.slice(run, 2, F.greatest(n - 2, F.lit(0))), lambda r: F.struct(F.lit("period").alias("kind"), r["lo"].alias("lo"), r["hi"].alias("hi"))),
        F.zip_with(F.slice(run, 1, F.greatest(n - 1, F.lit(0))), F.slice(run, 2, F.greatest(n - 1, F.lit(0))), lambda p, q: F.struct(F.lit("gap").alias("kind"), p["hi"].alias("lo"), q["lo"].alias("hi"))),
    )
    within = cells.where(n > 1).select("entity", F.inline(inside))

    ends = cells.select("entity", F.element_at("runs", 1).alias("head"), F.when(n > 1, F.element_at("runs", -1)).alias("tail"))
    whole = ranges.select("entity", F.struct((F.col("lo") * unit).alias("lo"), (F.col("hi") * unit).alias("hi")).alias("head"), F.lit(None).cast("struct<lo:bigint,hi:bigint>").alias("tail"))
    pieces = ends.unionByName(whole).select("entity", F.explode(F.array_compact(F.array(F.struct(F.col("head").alias("at"), F.lit(False).alias("after")), F.when(F.col("tail").isNotNull(), F.struct(F.col("tail").alias("at"), F.lit(True).alias("after")))))).alias("p")).select("entity", "p.at.lo", "p.at.hi", "p.after")
    periods, across = _joined_pieces(pieces)
    out = within.unionByName(periods).unionByName(across)
    if longest_gap is not None:
        out = out.where((F.col("kind") == "period") | (F.col("hi") - F.col("lo") <= longest_gap))
    return out.withColumnRenamed("entity", entity)


def _joined_pieces(pieces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Periods of pieces (entity, lo, hi, after), and the gaps before those that are not after their own cell's runs.

    Pieces are ordered within stretches of 2**STRETCH_BITS cells; what the stretches before reach, and where the
    next period starts, comes from one summary row for each stretch. So no window holds more than a stretch's
    pieces, or one row for each stretch of an entity.
    """
    pieces = pieces.withColumn("stretch", F.shiftright("lo", CELL_BITS + STRETCH_BITS))
    order = Window.partitionBy("entity", "stretch").orderBy("lo", "hi", "after")
    stretches = Window.partitionBy("entity").orderBy("stretch")
    reach = pieces.groupBy("entity", "stretch").agg(F.max("hi").alias("reach"))
    reach = reach.select("entity", "stretch", F.max("reach").over(stretches.rowsBetween(Window.unboundedPreceding, -1)).alias("reached"), F.max("reach").over(Window.partitionBy("entity")).alias("last"))
    near = F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1))
    # the running end of all earlier pieces; the piece after a cell's inner runs never touches its cell's first
    placed = pieces.withColumn("near", near).join(reach, ["entity", "stretch"]).withColumn("before", F.greatest("near", "reached"))
    starts = placed.where("before is null or lo > before").select("entity", "stretch", "lo", "hi", "after", "before", "last")
    # a period ends where all is reached before the next starts
    firsts = starts.groupBy("entity", "stretch").agg(F.min_by("before", F.struct("lo", "hi", "after")).alias("first"))
    firsts = firsts.select("entity", "stretch", F.lead("first").over(stretches).alias("following"))
    ended = starts.withColumn("next", F.lead("before").over(order)).join(firsts, ["entity", "stretch"])
    periods = ended.select("entity", F.lit("period").alias("kind"), "lo", F.coalesce("next", "following", "last").alias("hi"))
    across = ended.where("before is not null and not after").select("entity", F.lit("gap").alias("kind"), F.col("before").alias("lo"), F.col("lo").alias("hi"))
    return periods, across


def segment_bounds(segments: DataFrame, recordings: DataFrame) -> DataFrame:
    """(rec_id, start_cs, end_cs) of usable segments; an end of -1 becomes the recording's duration.

    Open rows are reduced to the earliest start of each recording before they meet its duration: the union
    is the same, and no recording brings more than one row into the join.
    """
    start, end = centiseconds(F.col("start_sec")).alias("start_cs"), centiseconds(F.col("end_sec")).alias("end_cs")
    is_open = F.col("end_sec") == -1
    closed = segments.where(~is_open & F.col("end_sec").isNotNull()).select("rec_id", start, end)
    first = segments.where(is_open).select("rec_id", start).where("start_cs is not null").groupBy("rec_id").agg(F.min("start_cs").alias("start_cs"))
    full = recordings.select("rec_id", centiseconds(F.col("duration_sec")).alias("end_cs")).where("end_cs is not null")
    return closed.unionByName(first.join(full, "rec_id")).where("end_cs > start_cs")


def speech_periods(segments: DataFrame, recordings: DataFrame, longest_gap: int | None = 60_000) -> DataFrame:
    """Periods of speech and the gaps between them of each recording: (rec_id, kind, start_cs, end_cs)."""
    found = periods_and_gaps(segment_bounds(segments, recordings), "rec_id", "start_cs", "end_cs", longest_gap)
    return found.select("rec_id", "kind", F.col("lo").alias("start_cs"), F.col("hi").alias("end_cs"))
