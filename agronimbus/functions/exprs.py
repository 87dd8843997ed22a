"""Column expressions shared by the operators. All run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocab

WHITESPACE = " \t\n\r\x0b\x0c"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- numbers -----------------------------------------------------------------

def to_number(c) -> Column:
    """Double, or NULL for anything unparsable, NaN included."""
    x = _col(c).try_cast("double")
    return F.when(~F.isnan(x), x)


def number_or_zero(c) -> Column:
    return F.coalesce(to_number(c), F.lit(0.0))


def half_even(c, digits: int = 2) -> Column:
    """Scale, round to the nearest even integer, scale back: binary rounding, where
    ``bround`` rounds the decimal text of the number."""
    scale = F.lit(10.0 ** digits)
    return F.rint(_col(c) * scale) / scale


def clip(c, low=None, high=None) -> Column:
    """Bound a value; NULL stays NULL (``greatest`` alone would return the bound)."""
    x = _col(c)
    y = x
    if low is not None:
        y = F.greatest(y, F.lit(low))
    if high is not None:
        y = F.least(y, F.lit(high))
    return F.when(x.isNotNull(), y)


def truthy_or(c, default) -> Column:
    """``value or default``: missing, zero and empty text all give the default."""
    x = _col(c)
    empty = (x == F.lit("")) if isinstance(default, str) else (x == F.lit(0))
    return F.when(x.isNull() | empty, F.lit(default)).otherwise(x)


def decay_percent(distance, scale: float) -> Column:
    return F.exp(-_col(distance) / F.lit(float(scale))) * F.lit(100.0)


def spread(low: float, high: float, *key) -> Column:
    """A value in [low, high) fixed by the key, whatever the partitioning."""
    unit = F.pmod(F.xxhash64(*[_col(k) for k in key]), F.lit(1_000_000)) / F.lit(1e6)
    return F.lit(float(low)) + F.lit(float(high - low)) * unit


# --- text --------------------------------------------------------------------

def strip(c) -> Column:
    return F.btrim(_col(c), F.lit(WHITESPACE))


def normalise_text(c) -> Column:
    return F.lower(strip(c))


def capitalise(c) -> Column:
    """First letter upper, the rest lower (``initcap`` would touch every word)."""
    x = _col(c)
    return F.concat(F.upper(F.substring(x, 1, 1)), F.lower(F.substr(x, F.lit(2))))


def is_part_of(a, b) -> Column:
    """Either text contains the other."""
    return F.contains(_col(a), _col(b)) | F.contains(_col(b), _col(a))


def search_group(c, pattern: str, group: int) -> Column:
    """Capture group of the first match ignoring case, NULL without a match."""
    return F.nullif(F.regexp_extract(_col(c), "(?i)" + pattern, group), F.lit(""))


# --- dates -------------------------------------------------------------------

def compact_date(c) -> Column:
    return F.try_to_timestamp(_col(c), F.lit("yyyyMMdd")).cast("date")


def leading_date(c) -> Column:
    """Date part of ``YYYY-MM-DD HH:MM:SS`` text."""
    return F.left(_col(c), F.lit(10)).try_cast("date")


# --- classes -----------------------------------------------------------------

def weather_condition(temp="temp", rainfall="rainfall", humidity="humidity") -> Column:
    """First rule that holds wins."""
    t, r, h = _col(temp), _col(rainfall), _col(humidity)
    return (
        F.when(r > 8.0, "rainy")
        .when(r > 1.5, "showers")
        .when((t > 30.0) & (h < 50.0), "sunny")
        .when((h > 75.0) & (r <= 1.0), "humid_overcast")
        .when(t < 15.0, "cool")
        .otherwise("temperate")
    )


def risk_level(similarity, probability, prob_scale: str = "percent") -> Column:
    """Risk class from unrounded similarity (percent) and probability (fraction).

    ``prob_scale="fraction"`` compares the bare fraction with 75, under which
    ``low`` never occurs.
    """
    if prob_scale not in ("percent", "fraction"):
        raise ValueError(f"prob_scale is 'percent' or 'fraction', not {prob_scale!r}")
    p = _col(probability)
    if prob_scale == "percent":
        p = p * 100.0
    s = _col(similarity)
    return (
        F.when((s >= 85.0) & (p >= 75.0), "low").when(s >= 68.0, "medium").otherwise("high")
    )


def recommendation(similarity, success) -> Column:
    s, p = _col(similarity), _col(success)
    return (
        F.when((s >= 85) & (p >= 80), "yes")
        .when((s >= 70) & (p >= 60), "alternative option like this")
        .otherwise("no")
    )


def stage_end(duration, share: float) -> Column:
    return F.floor(_col(duration) * F.lit(float(share))).cast("int")


def _by_stage(day, duration, position: int) -> Column:
    d = _col(day)
    out = None
    for stage in vocab.STAGES:
        value = F.lit(stage[position])
        if stage[0] is None:
            return out.otherwise(value)
        hit = d <= stage_end(duration, stage[0])
        out = F.when(hit, value) if out is None else out.when(hit, value)


def growth_stage(day, duration) -> Column:
    return _by_stage(day, duration, 1)


def stage_activity(day, duration) -> Column:
    return _by_stage(day, duration, 2)


def millimetres_text(c) -> Column:
    """A rounded volume as text with at least one decimal: 4.2, 8.0, 0.35."""
    two = F.format_string("%.2f", _col(c))
    return F.regexp_replace(two, "0$", "")


def daily_actions(day, duration, volume, risk, needed=None) -> Column:
    """Irrigation, risk, task-day and stage texts, in that order."""
    v, r = _col(volume), _col(risk)
    needed = v > 0 if needed is None else _col(needed)
    head, tail = vocab.IRRIGATION_TEXT.split("%s")
    items = [
        F.when(needed, F.concat(F.lit(head), millimetres_text(v), F.lit(tail))).otherwise(
            F.lit(vocab.NO_IRRIGATION_TEXT)
        )
    ]
    items += [F.when(r == k, F.lit(text)) for k, text in vocab.RISK_TEXTS.items()]
    items += [F.when(_col(day).isin(days), F.lit(text)) for days, text in vocab.TASK_DAYS]
    items.append(stage_activity(day, duration))
    return F.array_compact(F.array(*items))


# --- hints in prose ----------------------------------------------------------

def duration_hint(c, unit: str = "days") -> Column:
    """Season length named in a text: a range's upper end, else a single number
    before the unit, else the number after "duration of"."""
    text = _col(c)
    upper = search_group(text, rf"(\d+)\s*(?:-|to)\s*(\d+)\s*(?:{unit})", 2)
    single = search_group(text, rf"(\d+)\s*(?:{unit})", 1)
    named = search_group(text, r"duration\s*(?:of|is)?\s*(\d+)", 1)
    return F.coalesce(upper, single, named).try_cast("bigint")


def temperature_hint(c, unit: str = "°?C") -> Column:
    """Upper end of a temperature range named in a text."""
    return search_group(c, rf"(\d+)\s*(?:-|to)\s*(\d+)\s*(?:{unit})", 2).try_cast("double")
