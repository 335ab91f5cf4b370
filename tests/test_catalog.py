"""The catalogue's layout and versions, and rollups kept by changes."""

import datetime as dt
import os
import random
import shutil
import threading

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from starledger.functions import sky
from starledger.functions.text import contains
from starledger.functions.text import nocase as F_nocase
from starledger.operators import stats, suggest, timeline
from starledger.operators.filters import ContainsFilter, Context, CoordinateFilter, FilterNameFilter, ObjectNameFilter, apply_filters
from starledger.plans import rollup
from starledger.plans.catalog import Catalog, Conflict
from starledger.plans.names import INDEXED, NameIndex, grams_of_pattern
from starledger.schema import IMAGE_FILES, LIBRARIES
from starledger.sources.headers import register
from starledger.streaming.ingest import ingest_stream

from .test_sources import fits_bytes, put


def images(spark, rows):
    """Rows given by some columns; the others are null."""
    return spark.createDataFrame([tuple(r.get(c) for c in IMAGE_FILES.names) for r in rows], IMAGE_FILES)


def scan_metrics(df, name):
    """A metric summed over the scans of a plan that ran."""
    df.collect()
    todo, total = [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        node = todo.pop()
        if "Adaptive" in node.nodeName():
            node = node.executedPlan()
        if node.nodeName().startswith("Scan"):
            total += node.metrics().get(name).get().value()
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return total


@pytest.fixture(scope="module")
def skyful(spark, tmp_path_factory):
    rng = random.Random(1)
    rows = [{"id": i, "library_id": 1, "path": f"/p/{i}", "type": 1, "kind": 1, "right_ascension": rng.uniform(0, 360), "declination": rng.uniform(-90, 90), "filter_name": rng.choice(["Ha", "hA", "L", f"F{i}"]), "object_name": f"M {i % 400}", "exposure": 1.0} for i in range(6000)]
    rows += [{"id": 9000 + i, "library_id": 1, "path": f"/q/{i}", "type": 2, "kind": 3} for i in range(50)]
    catalog = Catalog(spark, str(tmp_path_factory.mktemp("skyful")))
    catalog.write("image_files", images(spark, rows))
    return catalog


def ids(df):
    return sorted(r["id"] for r in df.select("id").collect())


@pytest.mark.parametrize("f", [CoordinateFilter(10.3, 20.5, 9.0), CoordinateFilter(0.1, -85, 8.0), CoordinateFilter(24, 90, 5.0), CoordinateFilter(5, 0, 0.0), CoordinateFilter(5, 0, 200.0), CoordinateFilter(12, 40, 6.0, mode="cone"), CoordinateFilter()])
def test_a_box_reads_few_files(skyful, f):
    every = skyful.read("image_files")
    read = skyful.read("image_files", filters=[f])
    assert ids(apply_filters([f], Context(), read)) == ids(apply_filters([f], Context(), every))
    if f.mode == "box" and f.radius == 9.0:  # half a hundredth of the sky
        found = apply_filters([f], Context(), read)
        assert 0 < scan_metrics(found, "numFiles") <= 0.05 * scan_metrics(every, "numFiles")


@settings(max_examples=200, deadline=None)
@given(st.floats(-20, 380), st.floats(-100, 100), st.floats(0, 60), st.floats(0, 60), st.integers(1, 40), st.data())
def test_ranges_hold_the_box(ra, dec, width, height, most, data):
    ranges = sky.cell_ranges((ra - width, ra + width), (dec - height, dec + height), most)
    assert len(ranges) <= max(1, most) and all(a <= b for a, b in ranges)
    x, y = data.draw(st.floats(ra - width, ra + width)), data.draw(st.floats(dec - height, dec + height))
    spread = lambda v: sum((v >> i & 1) << (2 * i) for i in range(sky.CELL_BITS))
    cell = spread(sky._axis(x, 0.0, 360.0)) | spread(sky._axis(y, -90.0, 180.0)) << 1
    assert any(a <= cell <= b for a, b in ranges)


def test_cells_as_columns(spark):
    rng = random.Random(2)
    points = [(rng.uniform(-10, 370), rng.uniform(-95, 95)) for _ in range(500)] + [(0.0, -90.0), (360.0, 90.0), (None, 1.0), (1.0, None), (float("nan"), 0.0)]
    spread = lambda v: sum((v >> i & 1) << (2 * i) for i in range(sky.CELL_BITS))
    for r in spark.createDataFrame(points, "x double, y double").withColumn("c", sky.sky_cell(F.col("x"), F.col("y"))).collect():
        known = r["x"] is not None and r["y"] is not None and r["x"] == r["x"]
        assert r["c"] == (spread(sky._axis(r["x"], 0.0, 360.0)) | spread(sky._axis(r["y"], -90.0, 180.0)) << 1 if known else None)


@pytest.mark.parametrize("f", [FilterNameFilter("HA|f17"), FilterNameFilter("nowhere"), ObjectNameFilter('"m 7"'), ObjectNameFilter("m 7"), FilterNameFilter("")])
def test_exact_names_reach_the_scan(skyful, f):
    read = apply_filters([f], Context(), skyful.read("image_files", filters=[f]))
    assert ids(read) == ids(apply_filters([f], Context(), skyful.read("image_files")))
    plan = read._jdf.queryExecution().executedPlan().toString()
    if f.exact_names():
        assert "_key, [" in plan.split("PushedFilters:")[1].split("ReadSchema")[0] or "_key," in plan.split("PushedFilters:")[1].split("ReadSchema")[0]
    if f.text == "nowhere":  # within the least and the greatest name, so bloom filters tell
        assert scan_metrics(read, "numOutputRows") < 0.05 * 6050


def written(root):
    return {os.path.join(d, n): os.path.getsize(os.path.join(d, n)) for d, _, names in os.walk(root) for n in names if n.endswith(".parquet")}


def test_a_batch_writes_what_it_brings(tmp_path, spark):
    root, catalog = tmp_path / "lib", Catalog(spark, str(tmp_path / "catalog"))
    catalog.write("libraries", spark.createDataFrame([(1, None, None, "a", str(root), None)], LIBRARIES))
    catalog.write("image_files", images(spark, [{"id": i, "library_id": i % 3, "path": f"/x/{i}" * 20, "header_hash": f"{i:040}", "object_name": f"name {i * 7919}", "type": 0, "kind": 0} for i in range(3000)]))
    before = written(tmp_path / "catalog/image_files")
    for n in ("a.fits", "b.fits"):
        put(root, n, fits_bytes([("OBJECT", f"'{n}'")]))
        ingest_stream(spark, catalog, 1, str(root), str(tmp_path / "checkpoint"), once=True).awaitTermination(120)
    after = written(tmp_path / "catalog/image_files")
    assert set(before) < set(after) and sum(after.values()) - sum(before.values()) < 0.5 * sum(before.values())
    assert catalog.read("image_files").count() == 3002 and catalog.read("image_files", libraries=[1]).count() == 1002
    assert len({r["id"] for r in catalog.read("image_files").collect()}) == 3002
    version = catalog.versions("image_files")[-1]
    assert catalog.add_images(catalog.read("image_files").limit(5), 1, stream=f"1 {tmp_path / 'checkpoint'}", number=0) == version
    assert catalog.read("image_files").count() == 3002 and written(tmp_path / "catalog/image_files") == after
    catalog.compact(1)
    assert catalog.read("image_files").count() == 3002 and catalog.read("image_files", version).count() == 3002
    catalog.drop_before("image_files", 1)
    assert catalog.read("image_files").count() == 3002 and len(catalog.versions("image_files")) == 1


def test_a_changed_library_is_written_alone(tmp_path, spark):
    root, catalog = tmp_path / "lib", Catalog(spark, str(tmp_path / "catalog"))
    catalog.write("libraries", spark.createDataFrame([(1, None, None, "a", str(root), None)], LIBRARIES))
    catalog.write("image_files", images(spark, [{"id": i, "library_id": 2, "path": f"/x/{i}", "type": 0, "kind": 0} for i in range(10)]))
    for size in (0, 1000):
        put(root, "a.fits", fits_bytes([("OBJECT", "'x'")]) + b"p" * size)
        ingest_stream(spark, catalog, 1, str(root), str(tmp_path / "checkpoint"), once=True).awaitTermination(120)
    row = catalog.read("image_files", libraries=[1]).collect()
    assert len(row) == 1 and row[0]["file_size"] == os.path.getsize(root / "a.fits") and row[0]["updated_on"] is not None
    newest = catalog.manifest("image_files", catalog.versions("image_files")[-1])["batches"]
    assert newest["2"] == catalog.manifest("image_files", 1)["batches"]["2"] and len(newest["1"]) == 1


def test_writers_never_share_a_version(tmp_path, spark):
    catalog = Catalog(spark, str(tmp_path / "catalog"))
    first = catalog.write("image_files", images(spark, [{"id": 1, "library_id": 1, "path": "/1"}]))
    rows = [images(spark, [{"id": 10 + i, "library_id": 1 + i % 2, "path": f"/{i}"}]) for i in range(4)]
    got = []
    threads = [threading.Thread(target=lambda i=i: got.append(catalog.add_images(rows[i], 1 + i % 2))) for i in range(4)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert sorted(got) == [2, 3, 4, 5] and ids(catalog.read("image_files")) == [1, 10, 11, 12, 13] and catalog.top_id() == 13
    with pytest.raises(Conflict):
        catalog.add_images(rows[0].limit(0), 1, kept=catalog.read("image_files", first, [1]), since=first)
    assert catalog.versions("image_files")[-1] == 5


def test_unfinished_manifests_dont_count(tmp_path, spark):
    catalog = Catalog(spark, str(tmp_path / "catalog"))
    catalog.write("tags", spark.createDataFrame([], "id int, created_on timestamp_ntz, updated_on timestamp_ntz, name string, color string"))
    (tmp_path / "catalog/tags/_log/v2.json").write_text('{"batches": {')
    assert catalog.versions("tags") == [1] and catalog.version("tags") == 1 and catalog.read("tags").count() == 0
    assert catalog._free("tags", 1) is None  # its writer may still be at it
    os.utime(tmp_path / "catalog/tags/_log/v2.json", (1, 1))
    assert catalog.write("tags", catalog.read("tags")) == 3 and catalog.versions("tags") == [1, 3]


def test_rollups_equal_recounting_after_any_changes(spark):
    rng = random.Random(5)

    def image(i):
        return {"id": i, "library_id": rng.choice([1, 2, None]), "path": f"/{i}", "type": rng.choice([1, 1, 2]), "kind": rng.choice([1, 2]), "filter_name": rng.choice(["Ha", "ha", None]), "object_name": rng.choice(["M 31", "m 31", "Élan", "", None]), "camera_name": rng.choice(["Cam", None]), "exposure": rng.choice([0.1, 300.0, 1e-9, None]), "observation_timestamp_utc": rng.choice([None, dt.datetime(2024, 1, rng.randrange(1, 28), rng.randrange(24))])}

    held = {i: image(i) for i in range(60)}
    kept = {f: rollup.summed(f(images(spark, held.values()))) for f in (rollup.integration_rows, rollup.name_rows)}
    for step in range(3):
        gone = rng.sample(sorted(held), 12)
        edited = gone[:6]
        removed = images(spark, [held.pop(i) for i in gone])
        held |= (new := {i: image(i) for i in [*edited, *range(100 * (step + 1), 100 * (step + 1) + 8)]})
        kept = {f: spark.createDataFrame(rollup.changed(r, f, removed, images(spark, new.values())).collect(), r.schema) for f, r in kept.items()}
    now = images(spark, held.values())
    for f, r in kept.items():
        assert sorted(map(str, r.collect())) == sorted(map(str, rollup.summed(f(now)).collect()))
    sums, names = kept[rollup.integration_rows], kept[rollup.name_rows]
    start, end = dt.date(2024, 1, 2), dt.date(2024, 1, 25)
    close = lambda df: [(r[0], None if r[1] is None else pytest.approx(r[1])) for r in df.collect()]
    assert close(rollup.integration_by_night(sums, start, end)) == close(timeline.integration_by_night(now, start, end))
    assert close(rollup.integration_by_month(sums, start, end)) == close(timeline.integration_by_month(now, start, end))
    assert [(r[0], r[1], pytest.approx(r[2])) for r in rollup.integration_by_filter(sums).orderBy("filter").collect()] == [tuple(r) for r in stats.integration_by_filter(now).orderBy("filter").collect()]
    assert dict(map(tuple, rollup.library_counts(sums).collect())) == {r["library_id"]: r["count"] for r in now.groupBy("library_id").count().collect()}
    for text in ("m", "M_3", "%l", "ÉL", " ", None):
        found = rollup.suggestions(names, ["object_name", "filter_name"], text)
        assert found.collect() == suggest.suggestions([(now, "object_name"), (now, "filter_name")], text).collect()
    assert [r[0] for r in rollup.starting_with(names, "object_name", "m").collect()] == ["M 31"]


def test_summaries_follow_the_catalogue(tmp_path, spark):
    """After additions, changes, compaction and removal of versions a summary equals the recount of its version, and reads no images."""
    rng = random.Random(11)

    def image(i, library):
        return {"id": i, "library_id": library, "path": f"/{i}", "type": 1, "kind": 1, "filter_name": rng.choice(["Ha", "ha", "", None]), "object_name": rng.choice(["M 31", "m 31", "Élan", None]), "readout_mode": rng.choice(["Fast", None]), "exposure": rng.choice([0.1, 300.0, None]), "observation_timestamp_utc": dt.datetime(2024, 1, rng.randrange(1, 28), rng.randrange(24))}

    catalog = Catalog(spark, str(tmp_path / "catalog"))
    assert catalog.summary("integration").count() == 0 and catalog.names().count() == 0
    text = lambda df: sorted(map(str, df.collect()))

    def check(version=None, libraries=None):
        now = catalog.read("image_files", version, libraries)
        assert text(catalog.summary("integration", version, libraries)) == text(rollup.summed(rollup.integration_rows(now)))
        assert text(catalog.names(version, libraries)) == text(rollup.summed(rollup.name_rows(now)))
        for column, part in (("object_name", "1"), ("filter_name", "%"), ("readout_mode", "fas")):
            assert text(catalog.name_index(version, libraries).containing(column, part)) == text(NameIndex.of(now).containing(column, part))

    first = catalog.write("image_files", images(spark, [image(i, i % 3 or None) for i in range(40)] + [{"id": 99, "library_id": 7, "path": "/bare"}]))
    check(), check(libraries=[7]), check(libraries=[1, None])
    catalog.add_images(images(spark, [image(100 + i, 1) for i in range(10)]), 1)
    check()
    version = catalog.version("image_files")
    kept = catalog.read("image_files", version, [1]).where("id % 2 = 0").withColumn("object_name", F.lit("M 45"))
    catalog.add_images(images(spark, [image(200, 1)]), 1, kept=kept, since=version)
    check(), check(first), check(libraries=[1])
    catalog.compact(1)
    check()
    plan = rollup.suggestions(catalog.names(), ["object_name"], "m")._jdf.queryExecution().executedPlan().toString()
    assert "/catalog/names" in plan and "/catalog/image_files" not in plan
    with pytest.raises(Conflict):
        catalog.add_images(kept.limit(0), 1, kept=kept, since=first)
    catalog.drop_before("image_files", 1)
    check()
    parts = {kind: {os.path.relpath(d, tmp_path / "catalog" / kind).split("/sky_zone")[0] for d in map(os.path.dirname, written(tmp_path / "catalog" / kind))} for kind in ("image_files", "integration", "names")}
    assert parts["integration"] == parts["names"] == parts["image_files"]
    shutil.move(tmp_path / "catalog/integration", tmp_path / "gone")  # batches of an older library have none
    check()


@pytest.fixture(scope="module")
def names(spark, tmp_path_factory):
    rng = random.Random(8)
    values = ["".join(rng.choice("abAB%_ \\éÉ1") for _ in range(rng.randrange(9))) for _ in range(300)] + ["", "ab", "aba", None]
    df = images(spark, [{"id": i, "library_id": 1, "path": f"/{i}", "camera_name": v, "object_name": v and v[::-1]} for i, v in enumerate(values)]).cache()
    path = str(tmp_path_factory.mktemp("names"))
    NameIndex.of(df).write(path)
    return df, NameIndex.read(spark, path)


@settings(max_examples=25, deadline=None)
@given(st.text("abAB%_ \\éÉ1", max_size=7))
def test_looked_up_texts_equal_the_plain_search(names, text):
    df, index = names
    expected = sorted({r[0] for r in df.where(contains("camera_name", text)).select(F_nocase("camera_name")).collect()})
    assert sorted(r["key"] for r in index.containing("camera_name", text).collect()) == expected


@pytest.mark.parametrize("listed", [0, 1000])
def test_filters_use_the_index(names, listed, monkeypatch, spark):
    from starledger.plans import names as module

    monkeypatch.setattr(module, "LISTED_NAMES", listed)
    df, index = names
    aliases = spark.createDataFrame([(1, "AB", "ab1"), (2, "b", "xx")], "id int, object_name string, alias string")
    for f in (ContainsFilter("CameraName", "ab%1"), ContainsFilter("CameraName", "B"), ContainsFilter("CameraName", "zzz"), ObjectNameFilter("b1"), ObjectNameFilter('"AB"'), ContainsFilter("Path", "1")):
        with_index, without = (apply_filters([f], Context(df, aliases, names=n), df) for n in (index, None))
        assert ids(with_index) == ids(without)


def test_the_scan_gets_the_names_found(spark, tmp_path):
    catalog = Catalog(spark, str(tmp_path / "c"))
    catalog.write("image_files", images(spark, [{"id": i, "library_id": 1, "path": f"/{i}", "telescope_name": f"Tel {i % 50}"} for i in range(500)]))
    index, f = NameIndex.of(catalog.read("image_files")), ContainsFilter("TelescopeName", "EL 4")
    read = apply_filters([f], Context(names=index), catalog.read("image_files", filters=[f], names=index))
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "tel 4" in plan.split("PushedFilters:")[1].split("ReadSchema")[0]
    assert ids(read) == ids(catalog.read("image_files").where("telescope_name like 'Tel 4%'")) and len(ids(read)) == 110
    assert grams_of_pattern("aB%cdeF_") == ["cde", "def"] and "path" not in INDEXED


def test_time_ranges_of_plots_reach_the_scan(skyful):
    plot = timeline.integration_by_month(skyful.read("image_files"), dt.date(2024, 1, 1), dt.date(2024, 3, 1))
    pushed = plot._jdf.queryExecution().executedPlan().toString().split("PushedFilters:")[1].split("ReadSchema")[0]
    assert "GreaterThanOrEqual(observation_timestamp_local" in pushed and "LessThan(observation_timestamp_utc" in pushed and "EqualTo(type,1)" in pushed
