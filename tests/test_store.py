"""Listing and reading trees in any store, and XISF headers as columns against the file reader."""

import io
import os
import random
import struct

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyarrow import fs
from pyspark.sql import functions as F

from starledger.plans import xisf as columns
from starledger.sources import headers, listing, store, xisf

from .test_sources import fits_bytes, put, xisf_bytes

TREE = [".git/hidden.fits", "normal/visible.fits", "normal/deep/er/still/more/x.FIT", "$RECYCLE.BIN/a.fits", "site-packages/b.fits", "c.fitz", "d.xisf", "e.txt", ".fits", "normal/.a.fits", "_u.fits"]
FOUND = ["_u.fits", "d.xisf", "normal/.a.fits", "normal/deep/er/still/more/x.FIT", "normal/visible.fits"]


def plan(df):
    return df._jdf.queryExecution().toString()


def test_levels_find_what_the_rules_allow(tmp_path, spark):
    for name in TREE:
        put(tmp_path, name, b"x")
    names = lambda root: sorted(r["path"].removeprefix(str(root) + "/") for r in listing.walk_tree(spark, str(root)).collect())
    assert names(tmp_path) == FOUND and names(tmp_path / "$RECYCLE.BIN") == names(tmp_path / "nowhere") == [] and names(tmp_path / ".git") == ["hidden.fits"]
    root = str(tmp_path)
    paths = spark.createDataFrame([(f"{root}/{n}",) for n in TREE] + [("/elsewhere/a.fits",)], "path string")
    assert sorted(r["path"].removeprefix(root + "/") for r in paths.where(listing.walks_path(F.col("path"), F.lit(root))).collect()) == FOUND
    assert [listing.wanted_file(n.split("/")[-1]) for n in TREE] == [r[0] for r in paths.limit(len(TREE)).select(listing.walks_file(listing.filename("path"))).collect()]


def test_each_folder_is_listed_once_by_many_tasks(tmp_path, spark, monkeypatch):
    """A tree of five levels with one folder of many folders; each task writes what it lists."""
    log = tmp_path / "log"
    log.mkdir()
    for i in range(120):
        put(tmp_path, f"tree/a/b/hot/{i:03}/x/{i}.fits", b"x")
    put(tmp_path, "tree/a/top.fits", b"x")
    real, folder = store.entries, str(log)

    def counted(path):
        import os
        import uuid

        from pyspark import TaskContext

        with open(os.path.join(folder, uuid.uuid4().hex), "w") as f:
            f.write(f"{TaskContext.get().partitionId()} {path}")
        yield from real(path)

    monkeypatch.setattr(listing, "entries", counted)
    monkeypatch.setattr(listing, "TASK_FOLDERS", 10)
    assert listing.walk_tree(spark, str(tmp_path / "tree")).count() == 121
    listed = [p.read_text().split(" ", 1) for p in log.iterdir()]
    assert len(listed) == len({path for _, path in listed}) == 4 + 120 + 120
    assert len({part for part, path in listed if path.endswith("/x")}) > 6


def test_times_bound_a_scan(tmp_path, spark):
    path = put(tmp_path, "a.fits", b"x")
    created = os.stat(path).st_ctime
    os.utime(path, (created - 1000, created - 1000))
    found = lambda **k: listing.walk_tree(spark, str(tmp_path), **k).count()
    assert [found(), found(since=created - 10), found(since=created + 10), found(until=created + 10), found(until=created - 10)] == [1, 1, 0, 1, 0]


def test_scan_headers_equals_the_data_source(tmp_path, spark):
    for i in range(5):
        put(tmp_path, f"a/{i}.fits", fits_bytes([("OBJECT", f"'M {i}'"), ("EXPOSURE", "1.5"), ("FLAG", "T"), ("GAIN", str(i))]))
        put(tmp_path, f"a/b/c/{i}.xisf", xisf_bytes([("OBJECT", f"M {i}", "c")]))
    put(tmp_path, "broken.fits", b"nothing")
    for i in range(5):  # times between two microseconds
        os.utime(tmp_path / f"a/{i}.fits", ns=(0, 1_795_600_000_123_456_500 + 250 * i - 500))
    headers.register(spark)
    for compat in (False, True):
        one = headers.scan_headers(spark, str(tmp_path), compat_xisf_hash=compat)
        other = spark.read.format("image_headers").option("compat_xisf_hash", str(compat)).load(str(tmp_path))
        assert one.schema.simpleString() == other.schema.simpleString()
        assert sorted(map(str, one.collect())) == sorted(map(str, other.collect())) and one.count() == 11


def test_other_stores(tmp_path, monkeypatch):
    """A store that isn't the machine's own files is listed and read by its client, by ranges."""
    put(tmp_path, "root/n/a.fits", fits_bytes([("OBJECT", "'M 1'")]) + b"p" * 1_000_000)
    sub = fs.SubTreeFileSystem(str(tmp_path), fs.LocalFileSystem())
    monkeypatch.setattr(store, "located", lambda path: (sub, path.removeprefix("mine://s/"), "mine://s/"))
    assert [(e.path, e.is_folder) for e in store.entries("mine://s/root")] == [("mine://s/root/n", True)]
    assert [e.path for e in store.entries("mine://s/root/n")] == ["mine://s/root/n/a.fits"] and list(store.entries("mine://s/none")) == []
    digest, header, error = headers.read_file("mine://s/root/n/a.fits")
    assert error is None and header["items"][-1]["s"] == "M 1"
    with store.opened("mine://s/root/n/a.fits") as f:
        f.read(10)
        assert f.raw.tell() <= store.BUFFER


def test_paths_and_uris(tmp_path):
    path = put(tmp_path, "a b/ü.fits", b"x")
    assert [e.path for e in store.entries(f"file://{tmp_path}/a b")] == [f"file://{path}"] and store.opened(f"file://{path}").read() == b"x"
    assert store.located("/data/x")[1:] == ("/data/x", "") and store.located("C:\\x")[0] is None


XISF_FILES = [
    xisf_bytes([("OBJECT", "31", ""), ("FILTER", "T", ""), ("A", " x y ", "c"), ("E", "", ""), ("CAMGAIN", "120", ""), ("TELESCOP", "'RA''SA'", ""), ("RA", "(1,2)", ""), ("HISTORY", "x", "Integration with PixInsight 1.8"), ("BIG", "3000000000", ""), ("D", "1.5D+02", ""), ("Q", "'", "")], [("P:X", "Boolean", 'value="1"/>'), ("P:Y", "String", ">text</Property>"), ("P:V", "String", 'value="v"/>'), ("P:Z", "Float64", 'value="2.5"/>'), ("P:W", "F64Vector", 'value="1"/>'), ("P:I", "Int32", 'value="x"/>')], b"\0" * 9000),
    xisf_bytes([("A", "1", "")] * 600, (), b"zz"), xisf_bytes([("é", "ü &lt;&amp;", "&#233;")]), xisf_bytes([]),
    b"XISF0100" + struct.pack("<I", 4) + b"\0" * 4 + b"<x", b"nothing", b"XISF0100", b"", b"XISF0100" + struct.pack("<I", 0) + b"\0" * 4, b"XISF0100" + struct.pack("<i", -5) + b"\0" * 4 + b"abc",
    xisf_bytes([("B", "2", "")])[:-3], b"XISF0100" + struct.pack("<I", 8192) + b"\0" * 4 + b"y" * 8192 + b"z" * 10, b"XISF0100" + struct.pack("<I", 8193) + b"\0" * 4 + b"y" * 8193 + b"z" * 10_000,
]


@pytest.mark.parametrize("compat", [False, True])
def test_xisf_columns_equal_the_file_reader(spark, compat):
    df = spark.createDataFrame([(i, x, "kept") for i, x in enumerate([*XISF_FILES, None])], "id int, content binary, error string")
    read = columns.read_xisf(df, compat=compat)
    assert "Python" not in plan(read) and "Arrow" not in plan(read)
    for r in read.collect():
        try:
            header, digest = xisf.read_header(io.BytesIO(XISF_FILES[r["id"]] if r["id"] < len(XISF_FILES) else b""), compat)
        except ValueError:
            assert r["error"].startswith("HeaderError") and r["header"] is None and r["header_hash"] is None
            continue
        assert r["header_hash"] == digest and r["error"] is None
        assert (r["header"]["width"], r["header"]["height"], [i.asDict() for i in r["header"]["items"]]) == (header["width"], header["height"], header["items"])


ODD_XISF_FILES = [xisf_bytes([("A", "\xff", "")]).replace("\xff".encode(), b"\xff"), b"XISF0100" + struct.pack("<I", 200) + b"\0" * 4 + b'<xisf><Image geometry="1:2"><FITSKeyword/><Property/><FITSKeyword name="T" value="f">x</FITSKeyword></Image></xisf>' + b"\0" * 90]


def test_xisf_rows_and_shapes_equal_the_headers(spark):
    df = spark.createDataFrame([(i, x, "kept") for i, x in enumerate([*XISF_FILES, *ODD_XISF_FILES, None])], "id int, content binary, more string")
    headers = {compat: {r["id"]: r for r in columns.read_xisf(df, compat=compat).collect()} for compat in (False, True)}
    odd = headers[False][len(XISF_FILES)]  # not UTF-8: a header without items, as the file reader gives
    assert odd["error"] is None and odd["header"]["items"] == [] == xisf.read_header(io.BytesIO(ODD_XISF_FILES[0]))[0]["items"]
    rows = {}
    for r in columns.xisf_items(df).orderBy("id", "position").collect():
        assert r["more"] == "kept"
        rows.setdefault(r["id"], []).append(tuple(r[c] for c in ("keyword", "kind", "s", "b", "i", "d", "comment")))
    assert rows == {i: [tuple(x) for x in r["header"]["items"]] for i, r in headers[False].items() if r["header"] and r["header"]["items"]}
    for r in columns.xisf_shapes(df).collect():
        one = headers[False][r["id"]]
        assert (r["header_hash"], r["compat_hash"], r["error"]) == (one["header_hash"], headers[True][r["id"]]["header_hash"], one["error"])
        assert (r["width"], r["height"]) == ((one["header"]["width"], one["header"]["height"]) if one["header"] else (None, None))


@pytest.mark.parametrize("name", ["p3_p4_values", "s2_h2_xisf_headers"])
def test_xisf_queries_are_compiled_and_spread(spark, sf_dir, name):
    import __spark_entry__

    df = __spark_entry__.queries()[name](spark, sf_dir)
    text = df._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in text and text.count("from_xml(") == 1
    assert df.groupBy(F.spark_partition_id()).count().count() > spark.sparkContext.defaultParallelism


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(["T", "f", "'a''b'", "(1,2)", "( ", "'", "''", "1.", ".5", "+7", "1e5", "1d5", " 4 ", "NaN", "1f", "2147483648"]), st.text("0123456789.+-eEdD'()tfTF ,x", max_size=8)), min_size=1, max_size=20))
def test_values_by_look_equal_the_file_reader(spark, raws):
    from starledger.sources.values import item, typed_by_look

    df = spark.createDataFrame([(x,) for x in raws], "raw string").select("raw", columns.typed_value(F.col("raw")).alias("v"))
    for r in df.collect():
        value = typed_by_look(r["raw"])
        got = r["v"] and {k: r["v"][k] for k in ("kind", "s", "b", "i", "d")}
        assert got == (None if value is None else {k: item("", value)[k] for k in ("kind", "s", "b", "i", "d")}), r["raw"]


def test_random_trees(tmp_path, spark):
    rng = random.Random(3)
    for _ in range(60):
        put(tmp_path, "/".join([*(rng.choice(["a", "b", ".c", "$d", "site-packages"]) for _ in range(rng.randrange(5))), rng.choice(["x.fits", "y.fit", "z.XISF", "w.txt"])]), b"")
    expected = sorted(f.path for p, deep, shares in listing.folders(str(tmp_path)) for k in range(shares) for f in listing.walk(p, deep, share=(k, shares)))
    assert sorted(r["path"] for r in listing.walk_tree(spark, str(tmp_path)).collect()) == expected
