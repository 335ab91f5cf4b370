"""From header items to catalogue columns: image type, image kind and the header-derived columns.

Everything here is a column expression over the array of typed header items.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import IMAGE_KINDS, IMAGE_TYPES

def _items() -> Column:
    return F.col("header.items")


def first_item(keyword: str) -> Column:
    """The first item of a keyword, of any kind; keywords compare without case."""
    return F.get(F.filter(_items(), lambda e: F.upper(e["keyword"]) == keyword.upper()), F.lit(0))


def first_of_kind(keyword: str, kind: str) -> Column:
    """The first item of a keyword and kind."""
    return F.get(F.filter(_items(), lambda e: (F.upper(e["keyword"]) == keyword.upper()) & (e["kind"] == kind)), F.lit(0))


_SLOT = {"string": "s", "bool": "b", "int": "i", "float": "d"}
#: Column of the first items by keyword, while header columns are made.
FIRST = "_first"


def first_items(*keywords: str) -> Column:
    """A map of the first item of each of these keywords, and of the first of each kind as ``keyword|kind``, in one walk over all items."""
    of_use = F.transform(F.filter(_items(), lambda e: F.upper(e["keyword"]).isin(*keywords)), lambda e: F.struct(F.upper(e["keyword"]).alias("key"), e.alias("item")))
    both = F.flatten(F.array(of_use, F.transform(of_use, lambda x: F.struct(F.concat(x["key"], F.lit("|"), x["item"]["kind"]).alias("key"), x["item"].alias("item")))))
    # What is left is at most these keywords and their repeats.
    seen = F.transform(F.array(both), lambda all_: F.filter(all_, lambda x, i: F.array_position(F.transform(all_, lambda y: y["key"]), x["key"]) == i + 1))
    return F.map_from_entries(F.coalesce(F.get(seen, F.lit(0)), F.slice(both, 1, 0)))


def _first(keyword: str) -> Column:
    return F.try_element_at(F.col(FIRST), F.lit(keyword))


def value_of(keyword: str, kind: str) -> Column:
    """The value of the first item of a keyword, if it is of the kind."""
    one = _first(keyword)
    return F.when(one["kind"] == kind, one[_SLOT[kind]])


def first_value(kind: str, *keywords: str) -> Column:
    """The value of the first keyword that has one of the kind; texts are trimmed."""
    values = [F.trim(value_of(k, kind)) if kind == "string" else value_of(k, kind) for k in keywords]
    return values[0] if len(values) == 1 else F.coalesce(*values)


# The words for image types, lower-cased and without spaces, and what each processing history begins with.
TYPE_WORDS = {
    "Light": ("light", "lightframe", "science", "scienceframe", "masterlight"),
    "Bias": ("bias", "biasframe", "masterbias"),
    "Dark": ("dark", "darkframe", "masterdark", "flatdark", "darkflat"),
    "Flat": ("flat", "flatframe", "flatfield", "masterflat"),
}
STEPS = ("Calibration", "CosmeticCorrection", "Registration", "Debayer", "LocalNormalization")
# End of fixed values.


def image_type() -> Column:
    """IMAGETYP, or FRAMETYP where no IMAGETYP is a text."""
    told = F.coalesce(_first("IMAGETYP|string")["s"], _first("FRAMETYP|string")["s"])
    word = F.replace(F.lower(told), F.lit(" "), F.lit(""))
    return reduce(lambda c, t: c.when(word.isin(*TYPE_WORDS[t]), IMAGE_TYPES[t]), list(TYPE_WORDS)[1:], F.when(word.isin(*TYPE_WORDS["Light"]), IMAGE_TYPES["Light"])).otherwise(IMAGE_TYPES["Unknown"])


def image_kind(type_column: str = "type", path_column: str = "path") -> Column:
    """The kind by ordered rules: no items, masters, intermediate steps, stacking programs, then calibration and raw frames."""
    t = F.col(type_column)
    is_xisf = F.col(path_column).endswith(".xisf")
    history = lambda *starts: F.exists(_items(), lambda e: e["keyword"].isin("HISTORY", "COMMENT") & reduce(lambda a, b: a | b, [F.coalesce(e["comment"], F.lit("")).startswith(f"{s} with PixInsight") for s in starts]))
    step, integrated = history(*STEPS), history("Integration")
    signed = F.exists(_items(), lambda e: e["keyword"].isin(*[f"PCL:Signature:{s}" for s in STEPS]))
    told = F.coalesce(_first("IMAGETYP|string")["s"], F.lit(""))
    siril = F.coalesce(_first("PROGRAM|string")["s"], F.lit("")).rlike("(?i)siril")
    stacked = _first("STACKCNT|int").isNotNull()
    calibrating = t.isin(IMAGE_TYPES["Flat"], IMAGE_TYPES["Dark"], IMAGE_TYPES["Bias"])
    k = IMAGE_KINDS
    return (
        F.when(F.size(_items()) == 0, k["Processed"])
        .when(told.rlike("(?i)master"), k["Master"])
        .when(is_xisf & (step | signed), k["Intermediate"])
        .when(siril & calibrating & stacked, k["Master"])
        .when(siril & calibrating, k["Calibration"])
        .when(siril, k["Intermediate"])
        .when(~step & ~integrated & calibrating, k["Calibration"])
        .when(~step & ~integrated & (t == IMAGE_TYPES["Light"]), k["Raw"])
        .otherwise(k["Unknown"])
    )


def _number(double_keywords: tuple[str, ...]) -> Column:
    return first_value("float", *double_keywords)


def _timestamp(keyword: str) -> Column:
    """A header's time as written, or in UTC where it names a zone; what is no time is null."""
    return F.try_to_timestamp(first_value("string", keyword)).cast("timestamp_ntz")


# The keywords that a header's columns are read from, and those of its type and kind.
KEYWORDS = (
    "IMAGETYP FRAMETYP PROGRAM STACKCNT INSTRUME EXPOSURE EXPTIME SET-TEMP CCD-TSET CCD-TEMP GAIN CCD-GAIN EGAIN OFFSET XBINNING CCDXBIN XPIXSZ READOUTM "
    "FOCNAME FOCUSER FOCPOS FOCUSPOS FOCTEMP ROTNAME ROTATOR ROTATANG FWHEEL FILTER RA DEC CENTALT OBJCTALT CENTAZ OBJCTAZ TELESCOP FOCALLEN AIRMASS DATE-OBS DATE-LOC "
    "OBJECT SITELAT OBSLAT SITELONG SITELON OBSLONG SITEELEV SITEELV DEWPOINT HUMIDITY PRESSURE AMBTEMP"
).split()


# Which keywords give which column, in order.
def header_columns() -> dict[str, Column]:
    """The columns that a header gives, from the map of first items. The session's time zone should be UTC.

    Only exposure, both camera temperatures and binning take integers and reals; the other columns take
    one kind, and a value of the other leaves them null.
    """
    whole = lambda *k: first_value("int", *k)
    text = lambda *k: first_value("string", *k)
    return {
        "camera_name": text("INSTRUME"),
        "exposure": F.coalesce(_number(("EXPOSURE", "EXPTIME")), whole("EXPOSURE", "EXPTIME").cast("double")),
        "camera_temperature_set_point": F.coalesce(whole("SET-TEMP", "CCD-TSET").cast("double"), _number(("SET-TEMP", "CCD-TSET"))),
        "camera_temperature": F.coalesce(whole("CCD-TEMP").cast("double"), _number(("CCD-TEMP",))),
        "camera_gain": whole("GAIN", "CCD-GAIN", "EGAIN"),
        "camera_offset": whole("OFFSET"),
        "binning": F.coalesce(_number(("XBINNING", "CCDXBIN")).cast("int"), whole("XBINNING", "CCDXBIN")),
        "pixel_size": _number(("XPIXSZ",)),
        "readout_mode": text("READOUTM"),
        "focuser_name": text("FOCNAME", "FOCUSER"),
        "focuser_position": whole("FOCPOS", "FOCUSPOS"),
        "focuser_temperature": _number(("FOCTEMP",)),
        "rotator_name": text("ROTNAME"),
        "rotator_position": _number(("ROTATOR", "ROTATANG")),
        "filter_wheel_name": text("FWHEEL"),
        "filter_name": text("FILTER"),
        "right_ascension": _number(("RA",)),
        "declination": _number(("DEC",)),
        "altitude": _number(("CENTALT", "OBJCTALT")),
        "azimuth": _number(("CENTAZ", "OBJCTAZ")),
        "telescope_name": text("TELESCOP"),
        "focal_length": _number(("FOCALLEN",)),
        "airmass": _number(("AIRMASS",)),
        "observation_timestamp_utc": _timestamp("DATE-OBS"),
        "observation_timestamp_local": _timestamp("DATE-LOC"),
        "object_name": text("OBJECT"),
        "latitude": _number(("SITELAT", "OBSLAT")),
        "longitude": _number(("SITELONG", "SITELON", "OBSLONG")),
        "elevation": _number(("SITEELEV", "SITEELV")),
        "dew_point": _number(("DEWPOINT",)),
        "humidity": _number(("HUMIDITY",)),
        "pressure": _number(("PRESSURE",)),
        "temperature": _number(("AMBTEMP",)),
    }


def with_header_columns(scanned: DataFrame) -> DataFrame:
    """``scanned`` with type, kind and the header columns; a header's items are folded to a map of first items once."""
    typed = scanned.withColumn(FIRST, first_items(*KEYWORDS)).withColumn("type", image_type())
    return typed.withColumn("kind", image_kind()).withColumns(header_columns()).drop(FIRST)


# End of fixed values.
