"""Column expressions for the graph's scalar functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_TRIM = r"^\s+|\s+$"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, _TRIM, "")


def n_channel(text: Column) -> Column:
    """Size class: 0, 1 or 2 spaces are classes 1 to 3; longer texts 4, 5 or 6 by their length in characters."""
    spaces = F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))
    n = F.length(text)
    return F.when(spaces < 3, spaces + 1).when(n < 128, 4).when(n < 1024, 5).otherwise(6).cast("int")


def storage_class(text: Column) -> Column:
    return F.struct(F.length(text).alias("len"), n_channel(text).alias("class"))


def sttype_to_index(st: Column) -> Column:
    return st + 4


def index_to_sttype(i: Column) -> Column:
    return i - 4


def stindex_label(i: Column) -> Column:
    name = F.element_at(F.array(*map(F.lit, "EXPRESS CONTAINS LEADSTO NEAR LEADSTO CONTAINS EXPRESS".split())), i.cast("int"))
    return F.concat(F.when(i < 4, "-").when(i > 4, "+").otherwise(""), name)


def channel_name(st: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, "Im3 Im2 Im1 In0 Il1 Ic2 Ie3".split())), (st + 4).cast("int"))


def compile_context(labels: Column) -> Column:
    """Trimmed, without empty ones, sorted, once each, joined by commas."""
    return F.array_join(F.array_sort(F.array_distinct(F.filter(F.transform(labels, strip), lambda x: x != ""))), ",")


def context_labels(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, ","), strip), lambda x: x != "")


def query_labels(text: Column) -> Column:
    """Labels that commas or white space part."""
    return F.filter(F.split(text, r"[,\s]+"), lambda x: x != "")


def similar(full: Column, like: Column) -> Column:
    """Equal, or either is empty or 'any', or like is inside full."""
    loose = full.isin("", "any") | like.isin("", "any")
    return (full == like) | loose | F.contains(full, like)


def match_contexts(wanted: list[str], labels: Column) -> Column:
    """No wish and no label match everything; else some label is inside some wish."""
    if not wanted:
        return F.lit(True)
    return (F.size(labels) == 0) | F.exists(labels, lambda x: F.coalesce(*[F.when(similar(F.lit(w), x), True) for w in wanted], F.lit(False)))


def inhibition(labels: Column, include: list[str], exclude: list[str]) -> Column:
    """All included labels are there and no excluded one, without case."""
    low = F.transform(labels, F.lower)
    ok = F.lit(True)
    for x in include:
        ok &= F.array_contains(low, x.lower())
    for x in exclude:
        ok &= ~F.array_contains(low, x.lower())
    return ok


def escape_sql(c: Column) -> Column:
    return F.replace(c, F.lit("'"), F.lit("''"))


def escape_json(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"[\r\n]", ""), '"', '\\\\\\\\"')


def split_chapters(c: Column) -> Column:
    """Parts between commas that no space follows; a comma at the end stays."""
    return F.split(c, r",(?=[^ ])")


def sanitize_path(c: Column, empty: str = "any") -> Column:
    s = F.regexp_replace(F.regexp_replace(c, r"[^A-Za-z0-9]+", "_"), r"^_+|_+$", "")
    return F.when(s == "", empty).otherwise(s)


def list_to_text(c: Column) -> Column:
    return F.array_join(F.array_sort(c), ",")


def show_psi(etc: Column) -> Column:
    return F.concat(F.when(etc["e"], "event,").otherwise(""), F.when(etc["t"], "thing,").otherwise(""), F.when(etc["c"], "concept,").otherwise(""))


def dirac(c: Column) -> Column:
    """<a|b> and <a|ctx|b> as a struct (ok, from, to, context): the last part is where a path starts."""
    m = r"^\s*<([^|<>]+)\|(?:([^|<>]+)\|)?([^|<>]+)>\s*$"
    return F.struct(c.rlike(m).alias("ok"), F.regexp_extract(c, m, 3).alias("begin"), F.regexp_extract(c, m, 1).alias("end"), F.regexp_extract(c, m, 2).alias("context"))


def semantic_time(ts: Column) -> Column:
    """Season north and south, shift, weekday, day, month, year, hour and quarter."""
    north = F.element_at(F.array(*map(F.lit, ["N_Winter", "N_Spring", "N_Summer", "N_Autumn"])), ((F.month(ts) % 12) / 3).cast("int") + 1)
    south = F.element_at(F.array(*map(F.lit, ["S_Summer", "S_Autumn", "S_Winter", "S_Spring"])), ((F.month(ts) % 12) / 3).cast("int") + 1)
    shift = F.element_at(F.array(*map(F.lit, "Night Morning Afternoon Evening".split())), (F.hour(ts) / 6).cast("int") + 1)
    quarter = F.concat(F.lit("Qu"), (F.minute(ts) / 15).cast("int") + 1)
    parts = [north, south, shift, F.date_format(ts, "EEEE"), F.concat(F.lit("Day"), F.dayofmonth(ts)), F.date_format(ts, "MMMM"), F.concat(F.lit("Yr"), F.year(ts)), F.date_format(ts, "'Hr'HH"), quarter]
    return F.concat_ws(", ", *parts)


def time_key(ts: Column) -> Column:
    """Weekday, hour, quarter and five minutes: Mon:Hr09:Qu2-Min20_25."""
    start = (F.minute(ts) / 5).cast("int") * 5
    return F.format_string("%s:%s:Qu%d-Min%02d_%02d", F.date_format(ts, "EEE"), F.date_format(ts, "'Hr'HH"), (F.minute(ts) / 15).cast("int") + 1, start, (start + 5) % 60)


def show_duration(seconds: Column) -> Column:
    """Whole years of 365 days, days, hours and minutes; nothing is 0 Minutes."""
    s = seconds.cast("bigint")
    day = 86400
    parts = [(F.floor(s / (365 * day)), "Years"), (F.floor(s % (365 * day) / day), "Days"), (F.floor(s % day / 3600), "Hours"), (F.floor(s % 3600 / 60), "Minutes")]
    text = F.concat_ws(", ", *[F.when(n > 0, F.concat(n.cast("string"), F.lit(f" {unit}"))) for n, unit in parts])
    return F.when(text == "", "0 Minutes").otherwise(text)
