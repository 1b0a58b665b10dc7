"""Cron expressions as Spark column expressions (no UDF).

A 5-field cron string (minute hour day-of-month month day-of-week) is expanded into
sorted arrays of allowed values with ``split`` / ``transform`` / ``sequence``; each field
item may be ``*``, ``*/s``, ``a``, ``a-b``, ``a-b/s`` or ``a/s``, months and weekdays may
be given by their three-letter names, and weekday 7 is Sunday like 0.  A field that does
not parse (or is out of range) makes the whole schedule invalid (arrays null).

Day matching: by default both day-of-month and day-of-week must match
(``day_rule="and"``); ``day_rule="or"`` gives the classic rule where, when both fields are
restricted, either may match.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocab

_NUM = r"^[0-9]+$"
_STAR = r"^\*(/[0-9]+)?$"
_RANGE = r"^[0-9]+-[0-9]+(/[0-9]+)?$"
_FROM_STEP = r"^[0-9]+/[0-9]+$"


def _item_values(it: Column, lo: int, hi: int) -> Column:
    a = F.regexp_extract(it, r"^([0-9]+)", 1).try_cast("int")
    b = F.regexp_extract(it, r"^[0-9]+-([0-9]+)", 1).try_cast("int")
    s = F.regexp_extract(it, r"/([0-9]+)$", 1).try_cast("int")
    is_star, is_num = it.rlike(_STAR), it.rlike(_NUM)
    is_range, is_from = it.rlike(_RANGE), it.rlike(_FROM_STEP)
    start = F.when(is_star, F.lit(lo)).when(is_num | is_range | is_from, a)
    end = (F.when(is_star, F.lit(hi)).when(is_num, a).when(is_range, b).when(is_from, F.lit(hi)))
    step = F.coalesce(s, F.lit(1))
    ok = (start.isNotNull() & end.isNotNull() & (start >= lo) & (end <= hi) & (start <= end) & (step >= 1))
    return F.when(ok, F.sequence(start, end, step))


def field_values(field: Column, lo: int, hi: int, names: list[str] | None = None, first: int = 0) -> Column:
    """Sorted distinct allowed values of one cron field, or null when it does not parse."""
    f = F.upper(F.trim(field))
    if names:
        named = f
        for i, name in enumerate(names):
            named = F.regexp_replace(named, name, str(first + i))
        f = F.when(f.rlike("[A-Z]"), named).otherwise(f)
    vals = F.flatten(F.transform(F.split(f, ","), lambda it: _item_values(it, lo, hi)))
    return F.when(F.size(vals) > 0, F.array_sort(F.array_distinct(vals)))


def parse(cron: Column) -> dict[str, Column]:
    """Column expressions for the parsed parts of a cron string."""
    fields = F.split(F.trim(F.regexp_replace(cron, r"\s+", " ")), " ")

    def part(i: int) -> Column:
        return F.try_element_at(fields, F.lit(i))

    dow_raw = field_values(part(5), 0, 7, vocab.WEEKDAY_NAMES, 0)
    return {
        "n_fields": F.size(fields),
        "minutes": field_values(part(1), 0, 59),
        "hours": field_values(part(2), 0, 23),
        "doms": field_values(part(3), 1, 31),
        "months": field_values(part(4), 1, 12, vocab.MONTH_NAMES, 1),
        "dows": F.array_sort(F.array_distinct(F.transform(dow_raw, lambda v: v % 7))),
        "dom_star": F.coalesce(part(3).startswith("*"), F.lit(False)),
        "dow_star": F.coalesce(part(5).startswith("*"), F.lit(False)),
    }


def minutes_of_day(hours: Column, minutes: Column) -> Column:
    """Sorted fire minutes within a day: h*60+m for every allowed (h, m)."""
    return F.flatten(F.transform(hours, lambda h: F.transform(minutes, lambda m: h * 60 + m)))


def day_matches(d: Column, months: Column, doms: Column, dows: Column, dom_star: Column, dow_star: Column,
                day_rule: str = "and") -> Column:
    """Whether date ``d`` is a firing day."""
    m_ok = F.array_contains(months, F.month(d))
    dom_ok = F.array_contains(doms, F.dayofmonth(d))
    dow_ok = F.array_contains(dows, F.dayofweek(d) - 1)
    if day_rule == "and":
        return m_ok & dom_ok & dow_ok
    if day_rule == "or":
        return m_ok & F.when(dom_star | dow_star, dom_ok & dow_ok).otherwise(dom_ok | dow_ok)
    raise ValueError(f"unknown day rule {day_rule!r}")
