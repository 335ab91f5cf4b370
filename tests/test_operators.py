import datetime as dt

import pytest
from pyspark.sql import functions as F

from starledger.functions import sky, text
from starledger.operators import duplicates, edit, export, objects, stats, suggest, timeline
from starledger.operators.search import search
from starledger.schema import ASTROBIN_FILTERS, IMAGE_FILES, LIBRARIES, OBJECT_ALIASES, PERSISTED_FILTERS, TAGS

NOW = dt.datetime(2024, 6, 1)


@pytest.fixture(scope="module")
def make(spark):
    def build(rows):
        full = [tuple(({"id": i, "library_id": 1, "type": 1, "kind": 1} | r).get(f.name) for f in IMAGE_FILES.fields) for i, r in enumerate(rows)]
        return spark.createDataFrame(full, IMAGE_FILES)

    return build


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_integration_by_filter_keeps_none_null_and_case_apart(make):
    images = make([{"filter_name": f, "exposure": e} for f, e in (("Ha", 10.0), ("ha", 5.0), (None, 7.0), ("None", 1.0), ("Ha", None))] + [{"filter_name": "Ha", "exposure": 100.0, "type": 2}])
    assert rows(stats.integration_by_filter(images)) == [("Ha", 2, 10.0), ("None", 1, 7.0), ("ha", 1, 5.0), ("None", 1, 1.0)]
    assert rows(stats.integration_by_filter(images.limit(0))) == []


def test_totals(make):
    images = make([{"exposure": 1800.0, "file_size": 1 << 30}, {"exposure": 54.0, "file_size": 1 << 29}, {"type": 0, "exposure": 9e9}, {"type": 3}])
    assert rows(stats.totals(images)) == [(1854.0, "0.52", 2, 0, 1, 0, 1, "2/0/1/0/1", 3 << 29, "1.50 GB")]
    assert rows(stats.totals(images.limit(0)))[0][:2] == (0.0, "0.00")
    assert rows(stats.totals(make([{"exposure": 3600.0 * 12.25}])))[0][1] == "12.3"


def test_nights_begin_at_noon(make):
    day = dt.datetime(2024, 3, 1, 12)
    images = make([{"observation_timestamp_local": day - dt.timedelta(milliseconds=1), "exposure": 3600.0}, {"observation_timestamp_local": day, "exposure": 7200.0}, {"observation_timestamp_utc": day, "exposure": None, "kind": 2}])
    assert rows(timeline.integration_by_night(images, dt.date(2024, 2, 1), dt.date(2024, 3, 1))) == [("2024-02-29", 1.0), ("2024-03-01", 2.0)]
    assert rows(timeline.integration_by_month(images, dt.date(2024, 2, 1), dt.date(2024, 3, 1))) == [("2024-02", 1.0), ("2024-03", 2.0)]
    assert rows(timeline.integration_by_night(images, dt.date(2024, 2, 1), dt.date(2024, 3, 1), use_intermediate=True)) == [("2024-03-01", None)]


def test_both_camera_and_telescope_count(make):
    at = dt.datetime(2024, 3, 1, 22)
    images = make([{"camera_name": c, "telescope_name": t, "exposure": 3600.0, "observation_timestamp_local": at} for c, t in (("A", "X"), ("A", "Y"), ("B", "X"))])
    assert rows(timeline.integration_by_night(images, dt.date(2024, 3, 1), dt.date(2024, 3, 1), camera="a", telescope="x")) == [("2024-03-01", 1.0)]


def test_grid_of_whole_weeks_leaves_out_the_last_date(make):
    start, end = dt.date(2024, 3, 1), dt.date(2024, 3, 8)
    images = make([{"observation_timestamp_local": dt.datetime(2024, 3, d, 22), "exposure": 3600.0} for d in (1, 8)])
    cells = rows(timeline.night_grid(images, start, end))
    assert len(cells) == 7 and cells[0] == (0, 0, start, 1.0) and sum(c[3] for c in cells) == 1.0
    assert len(rows(timeline.night_grid(images, start, end + dt.timedelta(days=1)))) == 14
    assert len(rows(timeline.night_grid(images, start, start))) == 7
    assert rows(timeline.night_grid(images, end, start))[0][2] == start


def test_default_ranges():
    assert timeline.default_range(dt.date(2024, 2, 29), "nights") == (dt.date(2023, 2, 28), dt.date(2024, 2, 29))
    assert timeline.default_range(dt.date(2024, 5, 31), "objects")[0] == dt.date(2024, 2, 29)
    assert timeline.preset(dt.date(2024, 5, 31), 24)[0] == dt.date(2022, 5, 31)


def test_objects_group_without_ascii_case(make):
    at = dt.datetime(2024, 3, 1, 22)
    images = make([{"object_name": n, "exposure": 3600.0, "observation_timestamp_local": at} for n in ("M 31", "m 31", "Élan", "élan", None)] + [{"object_name": "late", "exposure": 1.0, "observation_timestamp_local": at + dt.timedelta(seconds=1)}])
    got = rows(objects.integration_by_object(images, at, at))
    assert sorted(got) == [("M 31", 2.0), ("Élan", 1.0), ("élan", 1.0)]


def brute_cut(slices, percent):
    left, kept = sum(v for _, v in sorted(slices)), []
    for n, v in sorted(slices):
        if v <= percent / 100 * left:
            left -= v
        else:
            kept.append((n, v))
    return kept


@pytest.mark.parametrize("values", [[90.0, 2.0, 1.9, 1.0], [1.0, 1.9, 2.0, 90.0], [0.0, 0.0], [5.0], []])
def test_small_slices_go_in_order(spark, values):
    slices = [(f"o{i}", v) for i, v in enumerate(values)]
    df = spark.createDataFrame(slices, "object_name string, hours double")
    assert [(r[0], r[1]) for r in rows(objects.cut_small_slices(df, 2.0))] == brute_cut(slices, 2.0)


def test_duplicates_are_found_in_one_library_and_shown_from_all(make):
    images = make([{"header_hash": h, "library_id": l, "type": t} for h, l, t in (("b1", 1, 1), ("B1", 1, 1), ("b1", 2, 3), ("a0", 1, 1), ("a0", 2, 1), ("00", 1, 1), ("00", 1, 1), (None, 1, 1), (None, 1, 1))])
    got = sorted((r["id"], r["group_name"]) for r in duplicates.duplicates(images, 1).collect())
    assert got == [(0, "Group 2"), (1, "Group 2"), (2, "Group 2"), (5, "Group 1"), (6, "Group 1")]
    assert sorted(r["id"] for r in duplicates.duplicates(images, 1, lights_only=True).collect()) == [0, 1, 5, 6]
    assert duplicates.duplicates(images, 2).count() == 0


def test_scrub_removes_missing_files_that_are_shown(make, spark):
    images = make([{"header_hash": "a", "path": f"p{i}", "type": 1 if i < 3 else 2} for i in range(5)])
    left = duplicates.scrub_missing(images, duplicates.duplicates(images, 1, lights_only=True), spark.createDataFrame([("p0",)], "path string"))
    assert sorted(r["id"] for r in left.collect()) == [0, 3, 4]


def test_suggestions(make, spark):
    images = make([{"object_name": n} for n in ("M 31", "m 31", "NGC 31", "", None, "M 42")] + [{"object_name": f"Z31 {i:02}"} for i in range(40)])
    got = [r[0] for r in rows(suggest.suggestions([(images, "object_name")], "31"))]
    assert got[:3] == ["M 31", "NGC 31", "Z31 00"] and len(got) == 25
    assert rows(suggest.suggestions([(images, "object_name")], " ")) == rows(suggest.suggestions([(images, "object_name")], None)) == []
    aliases = spark.createDataFrame([(1, "m 31", "Andromeda"), (2, "M 31", "andromeda b")], OBJECT_ALIASES)
    assert dict(rows(suggest.names_with_aliases(images, aliases)))["M 31"] == ["Andromeda", "andromeda b"]


def test_search_nests_tags(make, spark):
    images = make([{"library_id": 1}, {"library_id": 2}, {"library_id": 9}])
    libraries = spark.createDataFrame([(1, None, None, "one", "", None), (2, None, None, "two", "", None)], LIBRARIES)
    tags = spark.createDataFrame([(1, None, None, "b", "#1"), (2, None, None, "a", "#2")], TAGS)
    bridge = spark.createDataFrame([(0, 1), (0, 2)], "image_id long, tag_id int")
    found = {r["id"]: r for r in search(images, libraries, tags, bridge).collect()}
    assert sorted(found) == [0, 1] and [t["name"] for t in found[0]["tags"]] == ["a", "b"] and found[1]["tags"] == []
    assert found[1]["library_name"] == "two" and len(found[0]) == 41 - 1 and "header_hash" not in found[0]


def test_edits(make, spark):
    images = make([{"library_id": i % 2 + 1} for i in range(4)])
    bridge = spark.createDataFrame([(0, 1), (1, 1), (1, 2)], "image_id long, tag_id int")
    some = images.where("id < 2").select("id")
    assert sorted(rows(edit.add_tags(bridge, some, [2]))) == [(0, 1), (0, 2), (1, 1), (1, 2)]
    assert rows(edit.remove_tags(bridge, some.where("id = 1"), [1])) == [(0, 1), (1, 2)]
    assert rows(edit.clear_tags(bridge, some.where("id = 1"))) == [(0, 1)]
    left, left_tags = edit.delete_images(images, bridge, some)
    assert left.count() == 2 and left_tags.count() == 0
    edited = edit.bulk_edit(images, some, {"object_name": "M 1", "camera_gain": None}, NOW).orderBy("id").collect()
    assert [r["object_name"] for r in edited] == ["M 1", "M 1", None, None] and [r["updated_on"] for r in edited] == [NOW, NOW, None, None]
    with pytest.raises(ValueError):
        edit.bulk_edit(images, some, {"path": "x"}, NOW)
    libraries = edit.add_library(spark.createDataFrame([], LIBRARIES), NOW)
    libraries = edit.add_library(libraries, NOW, "two", "/two")
    assert [(r["id"], r["name"], r["created_on"]) for r in libraries.collect()] == [(1, "New Library", NOW), (2, "two", NOW)]
    assert edit.edit_library(libraries, 2, NOW, name="2").where("id = 2").first()["updated_on"] == NOW
    a, b, c = edit.delete_library(libraries, images, bridge, 1)
    assert a.count() == 1 and b.count() == 2 and rows(c) == [(1, 1), (1, 2)]
    tags = edit.add_tag(spark.createDataFrame([], TAGS), NOW, "t")
    assert tags.first()["color"] == "#ffffffff" and edit.edit_tag(tags, 1, NOW, color="#1").first()["color"] == "#1" and edit.delete_tag(tags, bridge, 1)[1].count() == 1


def test_aliases_filters_settings(spark):
    aliases = edit.add_alias(spark.createDataFrame([], OBJECT_ALIASES), " M 31 ", "Andromeda ")
    aliases = edit.add_alias(edit.add_alias(aliases, "M 32", "ANDROMEDA"), "x", " ")
    assert rows(aliases) == [(1, "M 31", "Andromeda"), (2, "M 32", "ANDROMEDA")]
    assert edit.delete_aliases_named(aliases, "andromeda").count() == 0 and edit.delete_alias(aliases, 1).count() == 1
    filters = edit.add_export_filter(spark.createDataFrame([], ASTROBIN_FILTERS), 44, "Ha")
    filters = edit.add_export_filter(filters, 44, "again")
    assert [(r["astrobin_id"], r["name"]) for r in filters.collect()] == [(44, "Ha")] and edit.remove_export_filter(filters, 44).count() == 0
    saved = edit.save_filters(spark, [("Airmass", "1|2")])
    assert saved.schema == PERSISTED_FILTERS
    settings = spark.createDataFrame([(1, True, False, False)], "id int, persist_filters_on_exit boolean, use_intermediate_frames_for_plots boolean, full_screen boolean")
    changed, kept = edit.set_settings(settings, saved, persist_filters_on_exit=False)
    assert changed.first()["persist_filters_on_exit"] is False and kept.count() == 0
    assert edit.set_settings(settings, saved, full_screen=True)[1].count() == 1


@pytest.mark.parametrize("groups,lines", [
    ([(3, 60, 1), (5, 120, 1), (4, 10, 2), (5, 20, 3), (6, 30, 4)], ["filter,number,duration", "1,3,60.0000", "1,5,120.0000", "2,4,10.0000", "3,5,20.0000", "4,6,30.0000"]),
    ([(3, 60, None)], ["number,duration", "3,60.0000"]),
    ([(3, 60, 1), (4, 120, None)], ["filter,number,duration", "1,3,60.0000", ",4,120.0000"]),
])
def test_acquisition_csv(spark, groups, lines):
    assert export.acquisition_csv(groups).splitlines() == lines
    df = spark.createDataFrame([(f"f{i}", f, float(s), c) for i, (c, s, f) in enumerate(groups)], "filter_name string, astrobin_id int, seconds double, count long")
    assert [r[0] for r in rows(export.acquisition_lines(df))] == lines


def test_groups_and_mapping(make, spark):
    images = make([{"filter_name": f, "exposure": e} for f, e in (("Ha", 60.0), ("HA", 60.0), (None, None), (" ", 0.0), ("L", 30.0))])
    groups = export.acquisition_groups(images)
    assert sorted(rows(groups)) == [("HA", 60.0, 2), ("L", 30.0, 1), ("None", 0.0, 2)]
    mapping = spark.createDataFrame([("ha", 7), ("NONE", None)], "name string, astrobin_id int")
    assert sorted(rows(export.mapped_groups(groups, mapping)), key=str) == [("HA", 7, 60.0, 2), ("None", None, 0.0, 2)]
    answer = spark.createDataFrame([('{"count": 1, "results": [{"id": 4422, "brandName": "Antlia", "name": "Green 2\\""}]}',), (None,), ("no json",)], "json string")
    assert rows(export.equipment_filters(answer)) == [(4422, 'Antlia Green 2"')]


def test_summaries(make):
    table = stats.integration_by_filter(make([{"filter_name": "Ha", "exposure": 3600.0 * 12}, {"filter_name": "L", "exposure": 900.0}]))
    lines = lambda df: [r["line"] for r in df.collect()]
    assert "\n".join(lines(export.summary_lines(table))) == "Total Integration: 12.3 hr\nHa: 12.0 hr\nL: 0.25 hr"
    assert lines(export.markdown_lines(table)) == ["| Filter | Exposures | Integration |", "|--------|----------:|------------:|", "| Ha     |         1 |     12.0 hr |", "| L      |         1 |     0.25 hr |", "| Total  |           |     12.3 hr |"]


def test_scalars(spark):
    df = spark.createDataFrame([("C:\\a\\b.fits", "abcdef", "LibraryName", dt.datetime(2024, 7, 1, 12))], "p string, t string, n string, u timestamp_ntz")
    r = df.select(text.filename("p"), text.truncated("t", 5), text.truncated("t", 2), text.humanised("n"), sky.local_of_utc(F.col("u"), "Europe/Berlin"), sky.utc_of_local(F.col("u"), "Europe/Berlin"), sky.seconds_of_interval(F.expr("INTERVAL '1:30' MINUTE TO SECOND"))).first()
    assert list(r) == ["b.fits", "ab...", "...", "Library Name", dt.datetime(2024, 7, 1, 14), dt.datetime(2024, 7, 1, 10), 90.0]
    common = stats.common_values(spark.createDataFrame([(1, "a", None), (1, None, None)], "x int, y string, z string"), ["x", "y", "z"]).first()
    assert list(common) == ["1", "<Multiple Values>", None]


def test_summaries_of_nothing_and_of_wide_names(spark):
    lines = lambda df: [r["line"] for r in df.collect()]
    none = spark.createDataFrame([], "filter string, count long, seconds double")
    assert lines(export.summary_lines(none)) == ["Total Integration: 0.00 hr"]
    assert lines(export.markdown_lines(none))[-1] == "| Total  |           |      0.0 hr |"
    wide = spark.createDataFrame([("a very long filter name", 12345678901, 3.6e12)], "filter string, count long, seconds double")
    made = lines(export.markdown_lines(wide))
    assert made[2] == "| a very long filter name | 12345678901 | 1000000000.0 hr |" and made[1] == "|-------------------------|------------:|----------------:|"
    assert len({len(x) for x in made}) == 1


def test_plan_of_copies(spark):
    paths = spark.createDataFrame([("/b/x.fits",), ("/a/x.fits",), ("/a/x.fits",), ("/a/y.fits",), (None,)], "path string")
    taken = spark.createDataFrame([("y.fits",)], "name string")
    plan = lambda **k: sorted(tuple(r) for r in export.copy_plan(paths, taken, **k).collect())
    assert plan() == [("/a/x.fits", "x.fits", True), ("/a/y.fits", "y.fits", False), ("/b/x.fits", "x.fits", False)]
    assert ("/a/y.fits", "y.fits", True) in plan(overwrite=True)
