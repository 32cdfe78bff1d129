"""Column functions: classification, addresses, dates, coordinates, HTML. All stay in the JVM."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from cellmart import model


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def classify(raw: Column) -> Column:
    """C11: the class of a raw type by the first rule that fits; null and unknown types are UNKNOWN."""

    def rules(low: Column) -> Column:
        out = None
        for name, words in model.TYPE_RULES:
            hit = low.rlike("|".join(map(re.escape, words)))
            out = F.when(hit, name) if out is None else out.when(hit, name)
        return out.otherwise("UNKNOWN")

    return let(F.lower(F.coalesce(raw, F.lit(""))), rules)


def _lookup(pairs, key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for p in pairs for x in p]), key)


def category_of(subcategory: Column) -> Column:
    """C12."""
    return _lookup([(s, c) for s, c, _ in model.TAXONOMY], subcategory)


def severity_of(subcategory: Column) -> Column:
    """C12."""
    return _lookup([(s, n) for s, _, n in model.TAXONOMY], subcategory)


def state_abbr(fips: Column) -> Column:
    """C15."""
    return F.try_element_at(F.create_map(*[F.lit(x) for p in model.STATES.items() for x in p]), fips)


def state_fips(abbr: Column) -> Column:
    """C15."""
    return F.try_element_at(F.create_map(*[F.lit(x) for k, v in model.STATES.items() for x in (v, k)]), abbr)


def timestamp(raw: Column) -> Column:
    """ISO forms with T or blank, with or without fraction and offset, or a date alone; else null. The pattern keeps the
    cast from reading a bare year or a bare time."""
    ok = raw.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}(:?\d{2})?)?)?$")
    return F.when(ok, raw.try_cast("timestamp"))


def timestamp_hhmm(date: Column, time: Column) -> Column:
    """C4: a date with a four-digit time. A time of another length leaves the date as it is; four signs that are no time give null."""
    day = F.date_trunc("day", timestamp(date))
    hour, minute = F.substring(time, 1, 2).try_cast("int"), F.substring(time, 3, 2).try_cast("int")
    good = hour.between(0, 23) & minute.between(0, 59)
    at = F.make_dt_interval(hours=hour, mins=minute)
    return F.when(time.isNull() | (F.length(time) != 4), timestamp(date)).when(good, day + at)


def timestamp_hhmmss(date: Column, time: Column) -> Column:
    """C4: a date with HH:MM:SS; an unreadable time leaves the date as it is."""
    part = lambda i: F.get(F.split(time, ":"), F.lit(i)).try_cast("int")
    good = time.rlike(r"^\d{1,2}:\d{2}:\d{2}$") & part(0).between(0, 23) & part(1).between(0, 59) & part(2).between(0, 59)
    at = F.make_dt_interval(hours=part(0), mins=part(1), secs=part(2).cast("decimal(18,6)"))
    return F.when(good, F.date_trunc("day", timestamp(date)) + at).otherwise(timestamp(date))


def timestamp_ms(ms: Column) -> Column:
    """C4: epoch milliseconds."""
    return F.timestamp_millis(ms.cast("long"))


def timestamp_mdy(raw: Column) -> Column:
    """C4: MM/DD/YYYY."""
    return F.when(raw.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), F.try_to_timestamp(raw, F.lit("M/d/yyyy")))


def coordinates(longitude: Column, latitude: Column) -> Column:
    """Both, or both null if one is missing, zero or out of range."""

    def checked(at: Column) -> Column:
        x, y = at["longitude"], at["latitude"]
        ok = x.between(-180, 180) & y.between(-90, 90) & (x != 0) & (y != 0)
        return F.struct(F.when(ok, x).alias("longitude"), F.when(ok, y).alias("latitude"))

    return let(F.struct(longitude.alias("longitude"), latitude.alias("latitude")), checked)


def first_filled(*columns: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns])


def joined(separator: str, *columns: Column) -> Column:
    """All that are neither null nor empty; null if none is."""
    return F.nullif(F.concat_ws(separator, *[F.nullif(c, F.lit("")) for c in columns]), F.lit(""))


def strip_html(raw: Column) -> Column:
    """C14: without tags; the four common entities decoded."""
    out = F.regexp_replace(raw, "<[^>]+>", "")
    for a, b in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("\xa0", " ")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.trim(out)


def clean_address(raw: Column) -> Column:
    """J: struct(kind, street, cross): STREET, INTERSECTION with both streets, or NONE."""
    none = F.lit(None).cast("string")
    kind = lambda k, a, b: F.struct(F.lit(k).alias("kind"), a.alias("street"), b.alias("cross"))

    def street(short: Column) -> Column:
        plain = F.regexp_replace(short, r"\s+(BLOCK|BLK)\s+OF\s+", " ")
        plain = F.regexp_replace(plain, r"^(\d+)\s*(?:BLOCK|BLK|BL)\s+", "$1 ")
        plain = F.trim(F.regexp_replace(plain, r"^XX(\d+)", "1$1"))
        return let(plain, lambda p: F.when(p == "", kind("NONE", none, none)).otherwise(kind("STREET", p, none)))

    def crossing(short: Column) -> Column:
        # Separators are tried in turn; one with nothing on a side doesn't count.
        out = None
        for sep in (" / ", " /", "/ ", " & ", " AND "):
            at = F.instr(short, sep)
            a, b = F.trim(F.substring(short, F.lit(1), at - 1)), F.trim(F.substring(short, at + len(sep), F.length(short)))
            hit = (at > 0) & (a != "") & (b != "")
            out = F.when(hit, kind("INTERSECTION", a, b)) if out is None else out.when(hit, kind("INTERSECTION", a, b))
        return out.otherwise(street(short))

    def known(up: Column) -> Column:
        return F.when((up == "") | up.isin(*model.NOT_ADDRESSES), kind("NONE", none, none)).otherwise(let(F.regexp_replace(up, r"\s+(EB|WB|NB|SB)$", ""), crossing))

    return let(F.upper(F.trim(F.coalesce(raw, F.lit("")))), known)


def one_line(street: Column, city: Column, state: Column) -> Column:
    return F.concat(street, F.lit(", "), city, F.lit(", "), state)


def normalize_address(raw: Column) -> Column:
    """J: capitals, punctuation to blanks, abbreviations expanded, single blanks."""
    names = F.create_map(*[F.lit(x) for p in (model.STREET_TYPES | model.DIRECTIONS).items() for x in p])
    tokens = F.filter(F.split(F.regexp_replace(F.upper(raw), r"[.,#'/\\\-]+", " "), r"\s+"), lambda t: t != "")
    return F.array_join(F.transform(tokens, lambda t: F.coalesce(F.try_element_at(names, t), t)), " ")


def normalize_street(number: Column, street: Column) -> Column:
    return F.when(F.trim(street) == "", "").otherwise(normalize_address(F.concat_ws(" ", F.nullif(F.trim(number), F.lit("")), F.trim(street))))


def normalize_state(state: Column) -> Column:
    up = F.upper(F.trim(state))
    return F.when(up.rlike("^[A-Z]{2}$"), up).otherwise(normalize_address(up))


def slug(raw: Column) -> Column:
    """C18."""
    return F.btrim(F.regexp_replace(F.lower(raw), "[^a-z0-9]+", "_"), F.lit("_"))


def tract_full_name(name: Column, county: Column, state: Column) -> Column:
    """C17."""
    return F.concat_ws(", ", name, county, state)


def geoid_prefix(geoid: Column, n: int) -> Column:
    """The state (2) or county (5) of a longer id."""
    return F.when(F.length(geoid) >= n, F.substring(geoid, 1, n))


def contains_any_case(column: Column, text: str) -> Column:
    """Substring without regard to case; % and _ in text are plain signs."""
    return column.ilike("%" + re.sub(r"([\\%_])", r"\\\1", text) + "%")
