import datetime as dt

import pytest

from starledger.operators.filters import CIRCLES, CONTAINED, DATES, RANGES, CircularFilter, CodeFilter, ContainsFilter, Context, CoordinateFilter, DateFilter, FilterNameFilter, LibraryFilter, ObjectNameFilter, RangeFilter, TagFilter, apply_filters, persist, recent, restore, restore_all
from starledger.schema import IMAGE_FILES


@pytest.fixture(scope="module")
def make(spark):
    def build(rows):
        full = [tuple(({"id": i, "library_id": 1, "type": 1, "kind": 1} | r).get(f.name) for f in IMAGE_FILES.fields) for i, r in enumerate(rows)]
        return spark.createDataFrame(full, IMAGE_FILES)

    return build


def ids(df):
    return sorted(r["id"] for r in df.select("id").collect())


def kept(images, f, **context):
    return ids(apply_filters([f], Context(images, **context), images))


def test_filter_names(make):
    images = make([{"filter_name": x, "path": f"/tmp/image-{x}.fits"} for x in ("L", "R", "G", "B", "Ha", "Sii", "Oiii")] + [{"filter_name": ""}, {}])
    for text in ("Ha", "ha", "HA"):
        assert kept(images, FilterNameFilter(text)) == [4]
    for text in ("ha|sii|oiii", "Ha|Sii|Oiii", "HA|SII|OIII"):
        assert kept(images, FilterNameFilter(text)) == [4, 5, 6]
    assert kept(images, FilterNameFilter("L|")) == [0, 7]
    assert kept(images, FilterNameFilter(None)) == kept(images, FilterNameFilter("")) == list(range(9))


def test_text_is_wild_and_folds_ascii_only(make):
    images = make([{"camera_name": x} for x in ("img\\a", "imgXa", "50% Élan", "50x élan", None)])
    assert kept(images, ContainsFilter("CameraName", "img\\A")) == [0]
    assert kept(images, ContainsFilter("CameraName", "IMG_a")) == [0, 1]
    assert kept(images, ContainsFilter("CameraName", "5%N")) == [2, 3]
    assert kept(images, ContainsFilter("CameraName", "Élan")) == [2]
    assert kept(images, ContainsFilter("CameraName", "\\")) == [0]


@pytest.mark.parametrize("low,high,expected", [(350, 10, [0, 1, 4]), (10, 350, [1, 2, 3, 4]), (-5, 20, [0, 1]), (300, None, [4]), (None, None, [0, 1, 2, 3, 4, 5])])
def test_circles(make, low, high, expected):
    images = make([{"azimuth": x, "rotator_position": x} for x in (0.0, 10.0, 100.0, 300.0 - 1, 350.0, None)])
    assert kept(images, CircularFilter("Azimuth", low, high)) == expected
    assert kept(images, CircularFilter("RotatorPosition", low, high)) == expected


def test_ranges_and_hours(make):
    images = make([{"right_ascension": x, "airmass": x / 100} for x in (0.0, 74.9, 75.0, 90.0, 90.1)] + [{}])
    assert kept(images, RangeFilter("RightAscension", 5, 6)) == [2, 3]
    assert kept(images, RangeFilter("Airmass", None, 0.7495)) == [0, 1]
    assert kept(images, RangeFilter("Airmass")) == list(range(6))


def test_objects_and_aliases(make, spark):
    images = make([{"object_name": x} for x in ("M 31", "m 31", "NGC 224", "M 310", "Andromeda", None)])
    aliases = spark.createDataFrame([(1, "m 31", "Andromeda Galaxy"), (2, "M 33", "Triangulum"), (3, None, "Andromeda x")], "id int, object_name string, alias string")
    assert kept(images, ObjectNameFilter('"M 31"'), aliases=aliases) == [0, 1]
    assert kept(images, ObjectNameFilter("andromeda"), aliases=aliases) == [0, 1, 4]
    assert kept(images, ObjectNameFilter("m 31"), aliases=aliases) == [0, 1, 3]
    assert kept(images, ObjectNameFilter("M 31")) == [0, 1, 3]


def test_tags_codes_libraries(make, spark):
    images = make([{"library_id": i % 3, "type": i % 5, "kind": i % 6} for i in range(12)])
    bridge = spark.createDataFrame([(1, 7), (1, 8), (2, 8), (3, 9)], "image_id long, tag_id int")
    assert kept(images, TagFilter([7, 8]), image_tags=bridge) == [1, 2]
    assert kept(images, TagFilter([]), image_tags=bridge) == list(range(12))
    assert kept(images, CodeFilter("ImageType", "Bias")) == [4, 9]
    assert kept(images, CodeFilter("ImageKind", "Processed")) == [5, 11]
    assert kept(images, LibraryFilter(2)) == [2, 5, 8, 11]
    assert kept(images, LibraryFilter(0)) == list(range(12))


def test_dates(make):
    day = dt.datetime(2024, 5, 3)
    times = [day, day + dt.timedelta(hours=23, minutes=59, seconds=59, milliseconds=999), day + dt.timedelta(days=1), None]
    images = make([{"observation_timestamp_utc": t, "observation_timestamp_local": t} for t in times])
    assert kept(images, DateFilter("ObservationEndUtc", day + dt.timedelta(hours=5))) == [0, 1]
    assert kept(images, DateFilter("ObservationBeginLocal", times[1])) == [1, 2]
    assert kept(images, recent(1, dt.datetime(2024, 5, 4, 12))) == [1, 2]


def test_coordinates(make):
    images = make([{"right_ascension": a, "declination": d} for a, d in ((359.9, 0.0), (0.5, 0.5), (1.0, -1.0), (1.1, 0.0), (10.0, 90.0), (None, 0.0))])
    assert kept(images, CoordinateFilter(0, 0, 1)) == [1, 2]
    assert kept(images, CoordinateFilter(0, 0, 1, mode="cone")) == [0, 1]
    assert kept(images, CoordinateFilter(0, None, 1)) == list(range(6))
    assert kept(images, CoordinateFilter(99, 95, 0)) == []


def test_everything_persists_and_comes_back():
    filters = [RangeFilter(n, 1.5, None) for n in RANGES] + [CircularFilter(n, None, 30) for n in CIRCLES] + [ContainsFilter(n, "a|b") for n in CONTAINED]
    filters += [DateFilter(n, dt.datetime(2024, 1, 2, 3, 4, 5, 600000)) for n in DATES] + [CodeFilter("ImageType", "Dark"), CodeFilter("ImageKind", "Raw"), FilterNameFilter("Ha|L"), ObjectNameFilter('"M 1"'), LibraryFilter(3), TagFilter([1, 2]), CoordinateFilter(5.5, None, 1.0)]
    assert len(filters) == 41
    pairs = persist(filters)
    assert restore_all(pairs) == filters
    assert ("CameraTemperatureSetpoint", "1.5|") in pairs and ("ObservationBeginUtc", "2024-01-02T03:04:05.6000000") in pairs and ("Coordinate", "5.5||1") in pairs
    assert persist([RangeFilter("Airmass"), ObjectNameFilter(None), CoordinateFilter(), TagFilter()]) == []
    for name, data in [("Airmass", "x"), ("Airmass", "|"), ("ImageType", "Nothing"), ("Tags", ""), ("ObservationEndUtc", "soon"), ("Unknown", "1"), ("Filter", None)]:
        assert restore(name, data) is None


def test_filters_are_pushed_to_the_scan(make, tmp_path, spark):
    make([{"exposure": 1.0, "path": "x"}]).write.parquet(str(tmp_path / "i"))
    images = spark.read.parquet(str(tmp_path / "i"))
    found = apply_filters([RangeFilter("Exposure", 60, None), CoordinateFilter(1, 1, 1), LibraryFilter(2)], Context(images), images).select("id")
    plan = found._jdf.queryExecution().executedPlan().toString()
    for piece in ("GreaterThanOrEqual(exposure,60.0)", "LessThanOrEqual(declination,2.0)", "EqualTo(library_id,2)"):
        assert piece in plan
    assert "camera_name" not in plan.split("ReadSchema")[1]
