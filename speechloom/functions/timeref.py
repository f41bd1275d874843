"""Times named in texts, and arithmetic on them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from speechloom.functions.text import bound, rewritten

#: Forms of times, units, keywords and separators (fixed values).
CLOCK = r"\d+(?::\d{1,2}){1,2}"
UNITS = "h|hr|hrs|hour|hours|m|min|mins|minute|minutes|s|sec|secs|second|seconds"
NUMBER = r"\d+(?:[.,]\d+)?"
TOKEN = rf"(?:{CLOCK}|{NUMBER}(?:\s*(?:{UNITS}))?)"
DASH = "(?:-|–|—|to)"
KEYWORD = "(?:at|around|near|timestamp|time)"

_RANGE = rf"(?i)({TOKEN})(\s*{DASH}\s*)({TOKEN})"
_BOX = rf"\[\s*({NUMBER})\s*,\s*({NUMBER})\s*\]"
_POINT = rf"(?i)({KEYWORD}\s*)({TOKEN})"
_BARE = rf"(?<![\d:]){CLOCK}(?![\d:])"
#: What a bare clock time may not overlap comes first, with the whole of a clock time in whose seconds a range begins
#: (`0:05 s - 12:00`); so a match of clock form alone is a bare one.
_ANY = rf"(?i)(?:{KEYWORD}\s*)?(?:{CLOCK}(?:[.,]\d+)?(?:\s*(?:{UNITS}))?|{TOKEN})\s*{DASH}\s*{TOKEN}|{KEYWORD}\s*{TOKEN}|{_BARE}"

RANGES = "array<struct<lo:double,hi:double>>"


def seconds_of(token: Column) -> Column:
    """Seconds of `mm:ss`, `hh:mm:ss`, `12.5`, `12,5` or a number with a unit of hours, minutes or seconds; else null.

    Parts of a clock time may have fractions; negative ones but the first give null.
    """
    text = F.replace(F.lower(F.trim(token)), F.lit(","), F.lit("."))
    parts = F.transform(F.split(text, ":"), lambda p: F.trim(p).try_cast("double"))
    clock = F.aggregate(parts, F.lit(0.0), lambda acc, p: acc * 60 + p)
    sound = F.size(parts).between(2, 3) & ~F.exists(F.slice(parts, 2, 2), lambda p: p.isNull() | (p < 0))
    unit = F.regexp_extract(text, r"([a-z]*)$", 1)
    scale = F.when(unit.startswith("h"), 3600.0).when(unit.startswith("m"), 60.0).otherwise(1.0)
    number = F.regexp_extract(text, r"^([0-9]+(?:\.[0-9]+)?)", 1).try_cast("double") * scale
    return F.when(text.contains(":"), F.when(sound, F.greatest(clock, F.lit(0.0)))).when(text.rlike(rf"^[0-9]+(?:\.[0-9]+)?\s*(?:{UNITS})?$"), number)


def time_ranges(text: Column) -> Column:
    """array<struct<lo, hi>> of the times in a text, sorted, neighbours within a millisecond once.

    Ranges `a-b`, `a to b`, `[a, b]`; points after at, around, near, timestamp or time (also inside another
    word), and clock times that are in none of those. Reversed ranges are turned; a point is a range of no length.
    """
    text = F.coalesce(text, F.lit(""))
    every = lambda pattern, i: F.regexp_extract_all(text, F.lit(pattern), F.lit(i))
    pairs = [F.arrays_zip(every(_RANGE, 1).alias("a"), every(_RANGE, 3).alias("b")), F.arrays_zip(every(_BOX, 1).alias("a"), every(_BOX, 2).alias("b"))]
    bare = F.filter(every(_ANY, 0), lambda t: t.rlike(f"^{CLOCK}$"))
    points = F.transform(F.concat(every(_POINT, 2), bare), lambda t: F.struct(t.alias("a"), t.alias("b")))
    timed = F.transform(F.concat(*pairs, points), lambda r: F.struct(seconds_of(r["a"]).alias("a"), seconds_of(r["b"]).alias("b")))
    turned = F.transform(F.filter(timed, lambda r: r["a"].isNotNull() & r["b"].isNotNull()), lambda r: F.struct(F.least(r["a"], r["b"]).alias("lo"), F.greatest(r["a"], r["b"]).alias("hi")))
    return without_near(F.array_sort(turned))


def without_near(ranges: Column, within: float = 1e-3) -> Column:
    """Sorted ranges without those that differ from the last kept one by less than a bound at both ends."""
    def add(kept: Column, r: Column) -> Column:
        last = F.try_element_at(kept, F.lit(-1))
        near = last.isNotNull() & (F.abs(last["lo"] - r["lo"]) < within) & (F.abs(last["hi"] - r["hi"]) < within)
        return F.when(near, kept).otherwise(F.concat(kept, F.array(r)))

    return F.aggregate(ranges, F.array().cast(RANGES), add)


def crop_windows(ranges: Column, duration: Column, collar: float) -> Column:
    """Ranges widened by a collar within [0, duration]; empty ones dropped, none merged."""
    wide = F.transform(ranges, lambda r: F.struct(F.greatest(r["lo"] - collar, F.lit(0.0)).alias("lo"), F.least(r["hi"] + collar, duration).alias("hi")))
    return F.filter(wide, lambda r: r["hi"] > r["lo"])


def local_time(at: Column, windows: Column) -> Column:
    """Where a time falls once the windows are put one after another: in the first that holds it; else null."""
    zero = F.struct(F.lit(0.0).alias("offset"), F.lit(None).cast("double").alias("found"))

    def step(acc: Column, w: Column) -> Column:
        inside = acc["found"].isNull() & at.between(w["lo"], w["hi"]) & (w["hi"] > w["lo"])
        return F.struct((acc["offset"] + F.greatest(w["hi"] - w["lo"], F.lit(0.0))).alias("offset"), F.when(inside, acc["offset"] + at - w["lo"]).otherwise(acc["found"]).alias("found"))

    return F.aggregate(windows, zero, step, lambda acc: acc["found"])


def clock_token(seconds: Column, hours: Column | bool = False) -> Column:
    """mm:ss, or hh:mm:ss, of rounded seconds."""
    s = F.bround(seconds).cast("bigint")
    long = F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60)
    short = F.format_string("%02d:%02d", F.floor(s / 60), s % 60)
    return F.when(F.lit(hours) if isinstance(hours, bool) else hours, long).otherwise(short)


def like_token(seconds: Column, token: Column) -> Column:
    """Seconds in the form of a token: a clock time, or a number in its unit, with two decimals if it has any."""
    v = F.greatest(seconds, F.lit(0.0))
    t = F.replace(F.lower(F.trim(token)), F.lit(","), F.lit("."))
    unit = F.coalesce(F.nullif(F.regexp_extract(t, r"([a-z]+)$", 1), F.lit("")), F.lit("s"))
    scaled = v / F.when(unit.startswith("h"), 3600.0).when(unit.startswith("m"), 60.0).otherwise(1.0)
    whole = lambda x: F.bround(x).cast("bigint").cast("string")
    number = F.when(t.contains("."), F.format_string("%.2f", F.bround(scaled, 2))).otherwise(whole(scaled))
    is_clock = clock_token(v, (F.size(F.split(t, ":")) == 3) | (v >= 3600))
    return F.when(t.contains(":"), is_clock).when(t.rlike(rf"^[0-9]+(?:\.[0-9]+)?\s*(?:{UNITS})?$"), F.concat(number, unit)).otherwise(F.concat(whole(v), F.lit("s")))


def in_local_time(text: Column, windows: Column) -> Column:
    """A text whose times are those of a recording cropped to windows (array<struct<lo, hi>>) put one after another.

    Three passes: ranges of which both ends fall into windows, points after a keyword, bare clock times. Each pass
    sees the text of the one before. Times outside the windows, ranges in brackets and texts without a window stay.
    """
    def moved(token: Column, kept: Column) -> Column:
        """The token in local time; null outside the windows."""
        spelled = lambda at, t: F.when(at.isNotNull(), like_token(at, t))
        return bound(token, lambda t: bound(seconds_of(t), lambda s: bound(local_time(s, kept), lambda at: spelled(at, t))))

    def of_range(m: Column, kept: Column) -> Column:
        a, between, b = (F.regexp_extract(m, f"^{_RANGE}$", i) for i in (1, 2, 3))
        return F.coalesce(F.concat(moved(a, kept), between, moved(b, kept)), m)

    def of_point(m: Column, kept: Column) -> Column:
        lead, t = (F.regexp_extract(m, f"^{_POINT}$", i) for i in (1, 2))
        return F.coalesce(F.concat(lead, moved(t, kept)), m)

    def of_clock(m: Column, kept: Column) -> Column:
        return F.when(m.rlike(f"^{CLOCK}$"), F.coalesce(moved(m, kept), m)).otherwise(m)

    def passes(kept: Column) -> Column:
        out = text
        for pattern, change in ((_RANGE, of_range), (_POINT, of_point), (_ANY, of_clock)):
            out = rewritten(out, pattern, lambda m, change=change: change(m, kept))
        return F.when(F.size(kept) > 0, out).otherwise(text)

    return bound(F.array_sort(F.filter(windows, lambda w: w["hi"] > w["lo"])), passes)


def merged_ranges(ranges: Column, gap: float = 0.0) -> Column:
    """Sorted ranges merged where the next starts no later than `gap` after the last end."""
    def add(kept: Column, r: Column) -> Column:
        last = F.try_element_at(kept, F.lit(-1))
        joins = last.isNotNull() & (r["lo"] <= last["hi"] + gap)
        longer = F.concat(F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0))), F.array(F.struct(last["lo"].alias("lo"), F.greatest(last["hi"], r["hi"]).alias("hi"))))
        return F.when(joins, longer).otherwise(F.concat(kept, F.array(r)))

    return F.aggregate(F.array_sort(ranges), F.array().cast(RANGES), add)


def sample_span(start: Column, end: Column, rate: Column, size: Column) -> Column:
    """struct<lo, hi> of sample numbers within a recording of a size: half-even rounded, an end below 0 means the whole."""
    clamp = lambda x: F.greatest(F.least(F.bround(x * rate).cast("bigint"), size), F.lit(0).cast("bigint"))
    whole = end < 0
    return F.struct(F.when(whole, F.lit(0).cast("bigint")).otherwise(clamp(start)).alias("lo"), F.when(whole, size).otherwise(clamp(end)).alias("hi"))


def chunks(duration: Column, size: float, overlap: float = 0.0) -> Column:
    """array<struct<lo, hi>>: chunks of a length from the start, each overlapping the one before; the last ends with the recording."""
    step = size - overlap
    n = F.greatest(F.ceil((duration - overlap) / step), F.lit(1)).cast("int")
    made = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct((i * F.lit(float(step))).alias("lo"), F.least(i * F.lit(float(step)) + F.lit(float(size)), duration).alias("hi")))
    return F.when(duration > 0, made).otherwise(F.array().cast(RANGES))
