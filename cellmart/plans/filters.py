"""One set of filter parameters, compiled to predicates of the fact, the cell cube and the hexagon cube."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from datetime import date, datetime, time, timedelta
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def csv_list(raw: str | None) -> tuple[str, ...]:
    """Trimmed parts without the empty ones; none means no filter."""
    return tuple(x for x in (p.strip() for p in (raw or "").split(",")) if x)


def parse_bbox(raw: str | None) -> tuple[float, float, float, float] | None:
    """West,south,east,north; unreadable parts are skipped, and only four numbers make a box."""
    found = []
    for p in (raw or "").split(","):
        try:
            found.append(float(p.strip()))
        except ValueError:
            continue
    return tuple(found) if len(found) == 4 else None


def expand_bbox(box: tuple[float, float, float, float], share: float) -> tuple[float, float, float, float]:
    """Wider by a share of its size on each side, within the globe."""
    w, s, e, n = box
    dx, dy = (e - w) * share, (n - s) * share
    return max(-180.0, w - dx), max(-90.0, s - dy), min(180.0, e + dx), min(90.0, n + dy)


def cell(x: float) -> int:
    return math.floor(x * 1000)


def _day(raw: str) -> str:
    return raw.split("T")[0][:10]


def _midnight(raw: str, later: int = 0) -> Column:
    """The day's beginning, or that of a later day, as a literal that reaches the scan; text that is no day is an error."""
    return F.lit(datetime.combine(date.fromisoformat(_day(raw)) + timedelta(days=later), time())).cast("timestamp_ntz")


def _date(raw: str) -> str:
    """A date or date and time; anything else is an error."""
    if not re.fullmatch(r"\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?Z?)?", raw):
        raise ValueError(f"not a date: {raw}")
    return raw.replace("T", " ").rstrip("Z")


@dataclass(frozen=True)
class Analytics:
    """Filters of the analytical tools; all that are set must hold."""

    city: str | None = None
    state: str | None = None
    tract_geoid: str | None = None
    place_geoid: str | None = None
    date_from: str | None = None
    date_to: str | None = None
    category: str | None = None
    subcategory: str | None = None
    severity_min: int | None = None

    def where(self) -> Column:
        c, out = F.col, [F.lit(True)]
        if self.city is not None:
            out.append(c("city").ilike(self.city))  # S14: the text is a pattern
        for name, value in (("state", self.state), ("category", self.category), ("subcategory", self.subcategory)):
            if value is not None:
                out.append(c(name) == value.upper())
        for name, value in (("tract_geoid", self.tract_geoid), ("place_geoid", self.place_geoid)):
            if value is not None:
                out.append(c(name) == value)
        if self.date_from is not None:
            out.append(c("occurred_at") >= F.lit(_date(self.date_from)).cast("timestamp_ntz"))
        if self.date_to is not None:
            out.append(c("occurred_at") <= F.lit(_date(self.date_to)).cast("timestamp_ntz"))
        if self.severity_min is not None and self.severity_min > 1:
            out.append(c("severity") >= self.severity_min)
        return reduce(lambda a, b: a & b, out)


@dataclass(frozen=True)
class Counts:
    """Filters of the map queries."""

    bbox: tuple[float, float, float, float] | None = None
    day_from: str | None = None
    day_to: str | None = None
    categories: tuple[str, ...] = ()
    subcategories: tuple[str, ...] = ()
    sources: tuple[str, ...] = ()
    state_fips: tuple[str, ...] = ()
    county_geoids: tuple[str, ...] = ()
    place_geoids: tuple[str, ...] = ()
    tract_geoids: tuple[str, ...] = ()
    neighborhood_ids: tuple[str, ...] = ()
    severity_min: int | None = None
    arrest: bool | None = None

    def _lists(self) -> list[Column]:
        names = {"category": self.categories, "subcategory": self.subcategories, "source_id": self.sources, "state_fips": self.state_fips, "county_geoid": self.county_geoids, "place_geoid": self.place_geoids, "tract_geoid": self.tract_geoids, "neighborhood_id": self.neighborhood_ids}
        out = [F.lit(True), *(F.col(k).isin(*v) for k, v in names.items() if v)]
        if self.severity_min is not None and self.severity_min > 1:
            out.append(F.col("severity") >= self.severity_min)
        return out

    def cells(self) -> Column:
        """On the cell cube: whole cells, days of both ends, undated rows only without a date filter."""
        out = self._lists()
        if self.bbox:
            w, s, e, n = map(cell, self.bbox)
            out += [F.col("cell_lng").between(w, e), F.col("cell_lat").between(s, n)]
        if self.day_from:
            out.append(F.col("day") >= _day(self.day_from))
        if self.day_to:
            out.append(F.col("day") <= _day(self.day_to))
        if self.arrest is not None:
            out.append(F.col("arrest") == int(self.arrest))
        return reduce(lambda a, b: a & b, out)

    def hexagons(self) -> Column:
        """On the hexagon cube: no box, and undated rows stand as the empty day."""
        return Counts(**{**self.__dict__, "bbox": None}).cells()

    def features(self, compat: bool = False) -> Column:
        """On the fact, by exact coordinates. compat compares the end's text as it stands, which leaves out its day."""
        out = self._lists()
        if self.bbox:
            w, s, e, n = self.bbox
            out += [F.col("longitude").between(w, e), F.col("latitude").between(s, n)]
        at = F.col("occurred_at")
        if compat:
            out += [at.cast("string") >= self.day_from] if self.day_from else []
            out += [at.cast("string") <= self.day_to] if self.day_to else []
        else:
            out += [at >= _midnight(self.day_from)] if self.day_from else []
            out += [at < _midnight(self.day_to, 1)] if self.day_to else []
        if self.arrest is not None:
            out.append(F.col("arrest_made") == int(self.arrest))
        return reduce(lambda a, b: a & b, out)
