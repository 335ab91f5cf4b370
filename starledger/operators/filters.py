"""Composable image filters.

A filter maps a DataFrame of images to the rows it keeps; unset filters keep all, null values never
match. Filters are applied one after another, which ANDs them: all are column predicates or
semi-joins, so Catalyst merges them and pushes ranges and equalities to the Parquet scan. Each filter
persists as a (name, data) pair and can be restored from it.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sky import cell_ranges, end_of_day
from ..functions.text import contains, nocase, nocase_text
from ..plans.names import INDEXED, NameIndex
from ..schema import IMAGE_KINDS, IMAGE_TYPES


@dataclass
class Context:
    """Tables that some filters consult. Null where a filter in use doesn't need it."""

    images: DataFrame | None = None
    aliases: DataFrame | None = None
    image_tags: DataFrame | None = None
    names: NameIndex | None = None  # where there is one, contained texts are looked up in it


class Filter:
    """Base: a predicate on one row. ``name`` is the persisted name."""

    name: str

    def predicate(self) -> Column | None:
        return None

    def apply(self, context: Context, images: DataFrame) -> DataFrame:
        p = self.predicate()
        return images if p is None else images.where(p)

    def exact_names(self, names: NameIndex | None = None) -> dict[str, set[str]]:
        """Columns that must have one of some folded names, for a scan that can skip others; ``names`` knows those that contain a text."""
        return {}

    def sky_ranges(self, most: int) -> list[tuple[int, int]] | None:
        """At most so many ranges of sky cells outside of which nothing passes, or None."""
        return None

    def data(self) -> str | None:
        raise NotImplementedError

    def persist(self) -> tuple[str, str] | None:
        """(name, data), or None where the filter is unset."""
        d = self.data()
        return None if d is None else (self.name, d)


def _number(text: str) -> float | None:
    try:
        return float(text)
    except ValueError:
        return None


def _text(value: float | None) -> str:
    return "" if value is None else f"{value:g}" if abs(value) < 1e15 and float(f"{value:g}") == value else repr(value)


#: Persisted name of each closed range: column, and what input is multiplied by.
RANGES = {
    "Airmass": ("airmass", 1.0),
    "Altitude": ("altitude", 1.0),
    "CameraBinning": ("binning", 1.0),
    "CameraGain": ("camera_gain", 1.0),
    "CameraOffset": ("camera_offset", 1.0),
    "CameraTemperature": ("camera_temperature", 1.0),
    "CameraTemperatureSetpoint": ("camera_temperature_set_point", 1.0),
    "Declination": ("declination", 1.0),
    "DewPoint": ("dew_point", 1.0),
    "Elevation": ("elevation", 1.0),
    "FocalLength": ("focal_length", 1.0),
    "FocuserPosition": ("focuser_position", 1.0),
    "FocuserTemperature": ("focuser_temperature", 1.0),
    "Humidity": ("humidity", 1.0),
    "Latitude": ("latitude", 1.0),
    "Longitude": ("longitude", 1.0),
    "PixelSize": ("pixel_size", 1.0),
    "Pressure": ("pressure", 1.0),
    "Temperature": ("temperature", 1.0),
    "Exposure": ("exposure", 1.0),
    "RightAscension": ("right_ascension", 15.0),
}


@dataclass
class RangeFilter(Filter):
    """``low <= column <= high``, either bound optional. Right ascension is given in hours."""

    name: str
    low: float | None = None
    high: float | None = None

    def predicate(self) -> Column | None:
        column, scale = RANGES[self.name]
        parts = []
        if self.low is not None:
            parts.append(F.col(column) >= self.low * scale)
        if self.high is not None:
            parts.append(F.col(column) <= self.high * scale)
        return reduce(lambda a, b: a & b, parts) if parts else None

    def data(self) -> str | None:
        return None if self.low is None and self.high is None else f"{_text(self.low)}|{_text(self.high)}"


# Names under which filters are persisted, and their columns (here, in CONTAINED and in DATES).
#: Circular ranges: column, and the bounds that count where one is missing.
CIRCLES = {"Azimuth": ("azimuth", 0.0, float("inf")), "RotatorPosition": ("rotator_position", float("-inf"), float("inf"))}


@dataclass
class CircularFilter(Filter):
    """A range of angles: where the lower bound is above the upper one, it runs through zero.

    Else the lower bound counts only if it is above 0.
    """

    name: str
    low: float | None = None
    high: float | None = None

    def predicate(self) -> Column | None:
        if self.low is None and self.high is None:
            return None
        column, least, most = CIRCLES[self.name]
        low, high = (least if self.low is None else self.low), (most if self.high is None else self.high)
        c = F.col(column)
        if low > high:
            return (c >= low) | (c <= high)
        parts = ([c >= low] if low > 0 else []) + ([c <= high] if high != float("inf") else [])
        return reduce(lambda a, b: a & b, parts) if parts else None

    def data(self) -> str | None:
        return None if self.low is None and self.high is None else f"{_text(self.low)}|{_text(self.high)}"


#: Columns that are searched for a text.
CONTAINED = {
    "CameraName": "camera_name",
    "FilterWheelName": "filter_wheel_name",
    "FocuserName": "focuser_name",
    "Path": "path",
    "ReadoutMode": "readout_mode",
    "RotatorName": "rotator_name",
    "TelescopeName": "telescope_name",
}


@dataclass
class ContainsFilter(Filter):
    """Text anywhere in a column, without ASCII case; ``%`` and ``_`` are wild."""

    name: str
    text: str | None = None

    def predicate(self) -> Column | None:
        return contains(CONTAINED[self.name], self.text) if self.text else None

    def apply(self, context: Context, images: DataFrame) -> DataFrame:
        if self.text and context.names is not None and CONTAINED[self.name] in INDEXED:
            return context.names.kept(images, CONTAINED[self.name], self.text)
        return super().apply(context, images)

    def exact_names(self, names: NameIndex | None = None) -> dict[str, set[str]]:
        column = CONTAINED[self.name]
        found = names.listed(column, self.text) if self.text and names is not None and column in INDEXED else None
        return {} if found is None else {column: set(found)}

    def data(self) -> str | None:
        return self.text or None


@dataclass
class FilterNameFilter(Filter):
    """One of the names between ``|`` signs, without ASCII case and untrimmed."""

    text: str | None = None
    name: str = "Filter"

    def predicate(self) -> Column | None:
        return nocase("filter_name").isin([nocase_text(x) for x in self.text.split("|")]) if self.text else None

    def exact_names(self, names: NameIndex | None = None) -> dict[str, set[str]]:
        return {"filter_name": {nocase_text(x) for x in self.text.split("|")}} if self.text else {}

    def data(self) -> str | None:
        return self.text or None


@dataclass
class ObjectNameFilter(Filter):
    """A quoted name exactly; else every object whose name, or an alias of it, contains the text."""

    text: str | None = None
    name: str = "ObjectName"

    def apply(self, context: Context, images: DataFrame) -> DataFrame:
        if not self.text:
            return images
        if self._quoted():
            return images.where(nocase("object_name") == nocase_text(self.text[1:-1]))
        # A row's own name is tested in place; only names that aliases add need a join.
        found = context.names.listed("object_name", self.text) if context.names is not None else None
        exact = nocase("object_name") == nocase_text(self.text)
        own = exact | contains("object_name", self.text) if found is None else nocase("object_name").isin(nocase_text(self.text), *found)
        if context.aliases is None:
            return images.where(own)
        added = context.aliases.where(contains("alias", self.text)).select(nocase("object_name").alias("_alias_of")).where("_alias_of is not null").distinct()
        kept = images.join(added, nocase(F.col("object_name")) == F.col("_alias_of"), "left").where(own | F.col("_alias_of").isNotNull())
        return kept.drop("_alias_of")

    def _quoted(self) -> bool:
        return bool(self.text) and len(self.text) > 1 and self.text[0] == self.text[-1] == '"'

    def exact_names(self, names: NameIndex | None = None) -> dict[str, set[str]]:
        return {"object_name": {nocase_text(self.text[1:-1])}} if self._quoted() else {}

    def data(self) -> str | None:
        return self.text or None


@dataclass
class LibraryFilter(Filter):
    library_id: int | None = None
    name: str = "Library"

    def predicate(self) -> Column | None:
        return F.col("library_id") == self.library_id if self.library_id and self.library_id > 0 else None

    def data(self) -> str | None:
        return str(self.library_id) if self.library_id else None


@dataclass
class CodeFilter(Filter):
    """An image type or kind, by name."""

    name: str
    value: str | None = None

    def predicate(self) -> Column | None:
        if self.value is None:
            return None
        return F.col("type") == IMAGE_TYPES[self.value] if self.name == "ImageType" else F.col("kind") == IMAGE_KINDS[self.value]

    def data(self) -> str | None:
        return self.value


@dataclass
class TagFilter(Filter):
    """Images with at least one of the tags."""

    tag_ids: list[int] = field(default_factory=list)
    name: str = "Tags"

    def apply(self, context: Context, images: DataFrame) -> DataFrame:
        if not self.tag_ids:
            return images
        tagged = context.image_tags.where(F.col("tag_id").isin(self.tag_ids)).select(F.col("image_id").alias("_tagged"))
        return images.join(tagged, F.col("id") == F.col("_tagged"), "left_semi")

    def data(self) -> str | None:
        return "|".join(map(str, self.tag_ids)) or None


#: Date filters: column, and whether the bound is an end.
DATES = {
    "ObservationBeginUtc": ("observation_timestamp_utc", False),
    "ObservationEndUtc": ("observation_timestamp_utc", True),
    "ObservationBeginLocal": ("observation_timestamp_local", False),
    "ObservationEndLocal": ("observation_timestamp_local", True),
}


@dataclass
class DateFilter(Filter):
    """From a time on, or up to the last millisecond of a day."""

    name: str
    when: dt.datetime | None = None

    def predicate(self) -> Column | None:
        if self.when is None:
            return None
        column, is_end = DATES[self.name]
        bound = F.lit((end_of_day(self.when) if is_end else self.when).isoformat(sep=" ")).cast("timestamp_ntz")
        return F.col(column) <= bound if is_end else F.col(column) >= bound

    def data(self) -> str | None:
        return None if self.when is None else self.when.strftime("%Y-%m-%dT%H:%M:%S.%f") + "0"


def recent(days: int, now: dt.datetime) -> DateFilter:
    """Observations of the last days before ``now`` (UTC)."""
    return DateFilter("ObservationBeginUtc", now - dt.timedelta(days=days))


@dataclass
class CoordinateFilter(Filter):
    """A box of right ascension (hours) and declination (degrees) around a point, half as wide as ``radius`` degrees both ways.

    The box neither wraps at 24 hours nor narrows with declination. ``mode='cone'`` is an addition: the
    true distance on the sphere, with a declination range that the scan can use.
    """

    right_ascension: float | None = None
    declination: float | None = None
    radius: float | None = 1.0
    mode: str = "box"
    name: str = "Coordinate"

    def _circle(self) -> tuple[float, float, float] | None:
        """Right ascension in degrees, declination and radius, within their limits."""
        if self.right_ascension is None or self.declination is None or self.radius is None:
            return None
        return min(360.0, max(0.0, self.right_ascension * 15)), min(90.0, max(-90.0, self.declination)), max(0.0, self.radius)

    def sky_ranges(self, most: int) -> list[tuple[int, int]] | None:
        if (circle := self._circle()) is None:
            return None
        ra, dec, r = circle
        return cell_ranges((ra - r, ra + r) if self.mode == "box" else (0.0, 360.0), (dec - r, dec + r), most)

    def predicate(self) -> Column | None:
        if (circle := self._circle()) is None:
            return None
        ra, dec, r = circle
        x, y = F.col("right_ascension"), F.col("declination")
        if self.mode == "box":
            return x.between(ra - r, ra + r) & y.between(dec - r, dec + r)
        half = F.sin(F.radians(y - dec) / 2) ** 2 + F.cos(F.radians(y)) * F.cos(F.radians(F.lit(dec))) * F.sin(F.radians(x - ra) / 2) ** 2
        return y.between(dec - r, dec + r) & (2 * F.asin(F.sqrt(F.least(F.lit(1.0), half))) <= F.radians(F.lit(r)))

    def data(self) -> str | None:
        if self.right_ascension is None and self.declination is None and self.radius == 1.0:
            return None
        return f"{_text(self.right_ascension)}|{_text(self.declination)}|{_text(self.radius)}"


def apply_filters(filters: Iterable[Filter], context: Context, images: DataFrame) -> DataFrame:
    """All filters, ANDed."""
    return reduce(lambda df, f: f.apply(context, df), filters, images)


def persist(filters: Iterable[Filter]) -> list[tuple[str, str]]:
    """The (name, data) pairs of the filters that are set."""
    return [p for f in filters if (p := f.persist()) is not None]


def restore(name: str, data: str | None) -> Filter | None:
    """The filter that a pair persisted, or None where the name is unknown or the data say nothing."""
    text = data or ""
    if name in RANGES or name in CIRCLES:
        low, _, high = text.partition("|")
        bounds = _number(low), _number(high)
        return None if bounds == (None, None) or "|" not in text else (RangeFilter if name in RANGES else CircularFilter)(name, *bounds)
    if name in CONTAINED:
        return ContainsFilter(name, text) if text else None
    if name in DATES:
        try:
            return DateFilter(name, dt.datetime.strptime(text[:26], "%Y-%m-%dT%H:%M:%S.%f"))
        except ValueError:
            return None
    if name in ("ImageType", "ImageKind"):
        return CodeFilter(name, text) if text in (IMAGE_TYPES if name == "ImageType" else IMAGE_KINDS) else None
    if name == "Coordinate":
        parts = [_number(x) for x in text.split("|", 2)]
        return CoordinateFilter(*parts) if len(parts) == 3 and parts != [None] * 3 else None
    if name == "Tags":
        ids = [int(x) for x in text.split("|") if x.lstrip("-").isdigit()]
        return TagFilter(ids) if ids else None
    if name == "Library":
        return LibraryFilter(int(text)) if text.isdigit() else None
    if name == "Filter":
        return FilterNameFilter(text) if text else None
    if name == "ObjectName":
        return ObjectNameFilter(text) if text else None
    return None


def restore_all(pairs: Iterable[tuple[str, str | None]]) -> list[Filter]:
    return [f for name, data in pairs if (f := restore(name, data)) is not None]
