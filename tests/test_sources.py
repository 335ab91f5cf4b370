import datetime as dt
import hashlib
import os
import struct

import pytest
from pyspark.sql import functions as F

from starledger.operators import export
from starledger.plans.catalog import Catalog
from starledger.plans.headers import with_header_columns
from starledger.plans.ingest import ingest, scanned_at
from starledger.schema import IMAGE_FILES, LIBRARIES, SCANNED
from starledger.sources import fits, listing, values, xisf
from starledger.sources.headers import estimated_count, register, scan_file
from starledger.streaming.ingest import ingest_stream


def card(keyword, value, comment=None):
    text = f"{keyword:<8}= {value:>20}" + (f" / {comment}" if comment else "")
    return text.ljust(80).encode("latin-1")


def fits_bytes(items, end=True):
    cards = [card("SIMPLE", "T"), card("BITPIX", "8"), card("NAXIS", "0")] + [c if isinstance(c, bytes) else card(*c) for c in items]
    data = b"".join(cards) + (fits.END if end else b"")
    return data + b" " * (-len(data) % 2880) + b"pixels" * 100


def xisf_bytes(keywords, properties=(), tail=b""):
    rows = "".join(f'<FITSKeyword name="{k}" value="{v}" comment="{c}"/>' for k, v, c in keywords) + "".join(f'<Property id="{i}" type="{t}" {v}' for i, t, v in properties)
    xml = f'<?xml version="1.0"?><xisf xmlns="http://www.pixinsight.com/xisf"><Image geometry="9576:6388:1">{rows}</Image></xisf>'.encode()
    return b"XISF0100" + struct.pack("<I", len(xml)) + b"\0" * 4 + xml + tail


def put(folder, name, data):
    path = os.path.join(str(folder), name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(data)
    return path


def parsed(spark, *paths):
    return [r.asDict() for r in with_header_columns(spark.createDataFrame([scan_file(listing.Found(p, os.path.getsize(p), 0, 0)) for p in paths], SCANNED)).orderBy("path").collect()]


@pytest.mark.parametrize("raw,expected", [("42", 42), ("-42", -42), ("+42", 42), ("0", 0), ("4.2", None), ("2.956025E+02", None), ("296E+02", None), ("2.956025D+02", None), ("3000000000", None), ("", None)])
def test_integers(raw, expected):
    assert values.parse_int(raw) == expected


@pytest.mark.parametrize("raw,expected", [("2.956025E+02", 295.6025), ("2.956025e+02", 295.6025), ("+2.956025E+02", 295.6025), ("2.956025D+02", 295.6025), ("2.956025d+02", 295.6025), ("-2.956025E+02", -295.6025), ("2.956025E-02", 0.02956025), ("-2.956025D-02", -0.02956025), ("296E+02", 29600.0), ("1E-05", 0.00001), ("4.2", 4.2), ("-4.2", -4.2), ("NOTANUMBER", None), ("REDCAM", None), ("'42'", None), ("(1,2)", None), ("T", None), ("", None), ("1.5f", None), ("NaN", None)])
def test_reals(raw, expected):
    assert values.parse_float(raw) == expected


def test_values_by_look():
    assert [values.typed_by_look(x) for x in ("T", "f", "120", "1.5", "(1,2)", "'it''s'", "Ha", "3000000000")] == [True, False, 120, 1.5, None, "it's", "Ha", 3e9]


def test_fits_cards(tmp_path, spark):
    items = [("OBJECT", "'M 31    '", "the target"), ("EXPOSURE", "2.956025D+02"), ("GAIN", "100"), ("FOCALLEN", "800"), ("XPIXSZ", "3.76"), ("BIG", "3000000000"), ("FLAG", "F"), b"COMMENT Calibration with PixInsight".ljust(80), b"HIERARCH ESO FOO = 'bar' / x".ljust(80), ("LONG", "'abc&'"), b"CONTINUE  'def' / more".ljust(80), ("IMAGETYP", "'Light Frame'"), ("DATE-OBS", "'2024-01-02T03:04:05.678'"), ("XBINNING", "2"), ("SET-TEMP", "-10"), ("INSTRUME", "'O''Cam '")]
    path = put(tmp_path, "a.fits", fits_bytes(items))
    with open(path, "rb") as f:
        header, digest = fits.read_header(f)
    by = {i["keyword"]: i for i in header["items"]}
    assert by["OBJECT"]["s"] == "M 31" and by["OBJECT"]["comment"] == "the target" and by["FLAG"]["b"] is False
    assert "BIG" not in by and "COMMENT" not in by and by["ESO FOO"]["s"] == "bar" and by["LONG"]["s"] == "abcdef"
    data = fits_bytes(items)
    assert digest == hashlib.sha1(data[: data.index(fits.END)]).hexdigest()
    row = parsed(spark, path)[0]
    assert (row["object_name"], row["exposure"], row["camera_gain"], row["pixel_size"], row["binning"], row["camera_temperature_set_point"]) == ("M 31", 295.6025, 100, 3.76, 2, -10.0)
    assert row["focal_length"] is None  # an integer where only reals count
    assert row["observation_timestamp_utc"] == dt.datetime(2024, 1, 2, 3, 4, 5, 678000) and (row["type"], row["kind"], row["camera_name"]) == (1, 1, "O'Cam")


@pytest.mark.parametrize("raw,expected", [("4", 4.0), ("4.2", 4.2)])
def test_exposure_takes_both_kinds(tmp_path, spark, raw, expected):
    rows = parsed(spark, put(tmp_path, "a.fits", fits_bytes([("EXPOSURE", raw)])), put(tmp_path, "b.xisf", xisf_bytes([("EXPOSURE", raw, "")])))
    assert [r["exposure"] for r in rows] == [expected, expected]


def test_broken_files_are_rows(tmp_path):
    paths = [put(tmp_path, "a.fits", fits_bytes([], end=False)), put(tmp_path, "b.xisf", b"nothing"), put(tmp_path, "c.fits", fits_bytes([("Z", "(1,2)")])), put(tmp_path, "d.xisf", b"XISF0100" + struct.pack("<I", 4) + b"\0" * 4 + b"<x"), str(tmp_path / "missing.fits")]
    rows = [scan_file(listing.Found(p, 0, 0, 0)) for p in paths]
    assert [r[6] is not None for r in rows] == [True, True, True, False, True]
    assert rows[3][5][3] == []


def test_xisf(tmp_path, spark):
    data = xisf_bytes([("OBJECT", "31", ""), ("FILTER", "T", ""), ("CAMGAIN", "120", ""), ("TELESCOP", "'RASA'", ""), ("RA", "(1,2)", ""), ("HISTORY", "x", "Integration with PixInsight 1.8"), ("IMAGETYP", "DARK", "")], [("PCL:X", "Boolean", 'value="1"/>'), ("PCL:Y", "String", ">text</Property>"), ("PCL:Z", "Float64", 'value="2.5"/>'), ("PCL:W", "F64Vector", 'value="1"/>')], b"\0" * 9000)
    path = put(tmp_path, "a.xisf", data)
    with open(path, "rb") as f:
        header, digest = xisf.read_header(f)
    with open(path, "rb") as f:
        assert xisf.read_header(f, True)[1] != digest
    by = {i["keyword"]: i for i in header["items"]}
    assert (header["width"], header["height"]) == (9576, 6388)
    assert by["CAMGAIN"]["kind"] == "int" and by["PCL:X"]["b"] is True and by["PCL:Y"]["s"] == "text" and by["PCL:Z"]["d"] == 2.5 and "PCL:W" not in by and "RA" not in by
    row = parsed(spark, path)[0]
    assert row["object_name"] is None and row["filter_name"] is None and row["telescope_name"] == "RASA" and (row["type"], row["kind"]) == (3, 0)


KINDS = [
    ([], "xisf", (0, 5)),
    ([("IMAGETYP", "Master Light", "")], "xisf", (1, 4)),
    ([("IMAGETYP", "LIGHT", ""), ("HISTORY", "", "Debayer with PixInsight")], "xisf", (1, 2)),
    ([("IMAGETYP", "LIGHT", ""), ("HISTORY", "", "Debayer with PixInsight")], "XISF", (1, 0)),
    ([("IMAGETYP", "LIGHT", ""), ("HISTORY", "", "Integration with PixInsight")], "xisf", (1, 0)),
    ([("IMAGETYP", "FlatDark", "")], "xisf", (3, 3)),
    ([("FRAMETYP", "bias frame", "")], "xisf", (4, 3)),
    ([("IMAGETYP", "5", ""), ("FRAMETYP", "Flat Field", "")], "xisf", (2, 3)),
    ([("IMAGETYP", "Science", "")], "xisf", (1, 1)),
    ([("IMAGETYP", "odd", "")], "xisf", (0, 0)),
    ([("IMAGETYP", "Flat", ""), ("PROGRAM", "Siril 1.2", ""), ("STACKCNT", "12", "")], "xisf", (2, 4)),
    ([("IMAGETYP", "Flat", ""), ("PROGRAM", "siril", "")], "xisf", (2, 3)),
    ([("IMAGETYP", "Light", ""), ("PROGRAM", "Siril", ""), ("STACKCNT", "12", "")], "xisf", (1, 2)),
    ([("PROGRAM", "Siril", "")], "xisf", (0, 2)),
]


def test_types_and_kinds(tmp_path, spark):
    paths = [put(tmp_path, f"{i:02}.{ext}", xisf_bytes(k)) for i, (k, ext, _) in enumerate(KINDS)] + [put(tmp_path, "99.xisf", xisf_bytes([("IMAGETYP", "Light", "")], [("PCL:Signature:Registration", "String", ">x</Property>")]))]
    assert [(r["type"], r["kind"]) for r in parsed(spark, *paths)] == [e for _, _, e in KINDS] + [(1, 2)]


def test_walk(tmp_path, spark):
    for name in (".git/hidden.fits", "normal/visible.fits", "normal/deep/er/still/x.FIT", "$RECYCLE.BIN/a.fits", "site-packages/b.fits", "c.fitz", "d.xisf", "e.txt"):
        put(tmp_path, name, b"x")
    names = lambda root: sorted(os.path.relpath(f.path, root) for p, deep, shares in listing.folders(str(root)) for k in range(shares) for f in listing.walk(p, deep, share=(k, shares)))
    assert names(tmp_path) == ["d.xisf", "normal/deep/er/still/x.FIT", "normal/visible.fits"]
    put(tmp_path, ".astrophotos/in.fits", b"x")
    assert names(tmp_path / ".astrophotos") == ["in.fits"]
    assert estimated_count(spark, str(tmp_path)) == 3 and estimated_count(spark, str(tmp_path / "nowhere")) == 0
    assert names(tmp_path / "$RECYCLE.BIN") == []


def test_walk_by_time(tmp_path):
    path = put(tmp_path, "a.fits", b"x")
    now = os.stat(path).st_ctime
    os.utime(path, (now - 1000, now - 1000))
    found = lambda since: [f.path for f in listing.walk(str(tmp_path), True, since)]
    assert found(None) == found(now - 10) == [path]  # modified before, created after
    assert found(now + 10) == []
    os.utime(path, (now + 1000, now + 1000))
    assert found(now + 10) == [path]


def test_scan_ingest_and_versions(tmp_path, spark):
    register(spark)
    data = xisf_bytes([("OBJECT", "Test-Target", ""), ("EXPOSURE", "60.0", "")])
    roots = [tmp_path / "one", tmp_path / "two"]
    for r in roots:
        put(r, "sub/deep/er/shared.xisf", data)
    catalog, now = Catalog(spark, str(tmp_path / "catalog")), dt.datetime(2024, 1, 1)
    for i, r in enumerate(roots, 1):
        plan = ingest(catalog.read("image_files"), spark.read.format("image_headers").load(str(r)), i, now)
        assert {x["status"]: x["count"] for x in plan.summary().collect()} == {"added": 1}
        catalog.write("image_files", plan.images)
    rows = catalog.read("image_files").orderBy("library_id").collect()
    assert [(r["library_id"], r["object_name"], r["exposure"], r["kind"]) for r in rows] == [(1, "Test-Target", 60.0, 0), (2, "Test-Target", 60.0, 0)] and len({r["id"] for r in rows}) == 2
    again = ingest(catalog.read("image_files"), spark.read.format("image_headers").load(str(roots[0])), 1, now)
    assert {x["status"]: x["count"] for x in again.summary().collect()} == {"skipped": 1} and again.images.count() == 2
    put(roots[0], "copy.xisf", data)
    put(roots[0], "bad.fits", b"x")
    more = ingest(catalog.read("image_files"), spark.read.format("image_headers").load(str(roots[0])), 1, now)
    assert {x["status"]: x["count"] for x in more.summary().collect()} == {"skipped": 1, "added": 1, "error": 1}
    os.remove(os.path.join(str(roots[0]), "bad.fits"))
    put(roots[0], "sub/deep/er/shared.xisf", data + b"more pixels")
    os.remove(os.path.join(str(roots[0]), "copy.xisf"))
    grown = ingest(catalog.read("image_files"), spark.read.format("image_headers").load(str(roots[0])), 1, now)
    assert {x["status"]: x["count"] for x in grown.summary().collect()} == {"updated": 1}
    assert grown.images.where("library_id = 1").first()["file_size"] == len(data) + 11
    assert catalog.versions("image_files") == [1, 2] and catalog.read("image_files", 1).count() == 1
    catalog.drop_before("image_files", 1)
    assert catalog.versions("image_files") == [2]
    libraries = spark.createDataFrame([(1, None, None, "a", "x", None)], LIBRARIES)
    assert scanned_at(libraries, 1, now).first()["last_scan"] == now


def checkpoint_files(spark):
    folder = (spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir")).removeprefix("file:")
    return sorted(os.path.join(d, n) for d, _, names in os.walk(folder) for n in names if n.startswith("part-"))


def test_stream_takes_new_files_once(tmp_path, spark):
    root, catalog = tmp_path / "lib", Catalog(spark, str(tmp_path / "catalog"))
    catalog.write("libraries", spark.createDataFrame([(1, None, None, "a", str(root), None)], LIBRARIES))
    before = checkpoint_files(spark)
    for n in ("a.fits", "p/q/r/b.fits"):
        put(root, n, fits_bytes([("OBJECT", f"'{n}'")]))
        query = ingest_stream(spark, catalog, 1, str(root), str(tmp_path / "checkpoint"), once=True)
        query.awaitTermination(120)
    assert sorted(r["object_name"] for r in catalog.read("image_files").collect()) == ["a.fits", "p/q/r/b.fits"]
    assert checkpoint_files(spark) == before  # a stream that runs for long leaves none
    assert catalog.read("libraries").first()["last_scan"] is not None


def test_copies(tmp_path, spark):
    paths = [put(tmp_path, "a/x.fits", b"1"), put(tmp_path, "b/x.fits", b"2"), put(tmp_path, "b/y.fits", b"3"), str(tmp_path / "none.fits")]
    put(tmp_path, "out/y.fits", b"old")
    df = spark.createDataFrame([(p,) for p in paths] + [(None,)], "path string")
    got = {os.path.basename(r["path"]): r["copied"] for r in export.copy_files(df, str(tmp_path / "out")).collect()}
    assert got == {"x.fits": True, "y.fits": False, "none.fits": False}
    assert open(tmp_path / "out/x.fits", "rb").read() == b"1" and open(tmp_path / "out/y.fits", "rb").read() == b"old"
    export.copy_files(df, str(tmp_path / "out"), overwrite=True).collect()
    assert open(tmp_path / "out/y.fits", "rb").read() == b"3"
    (tmp_path / "out/_staged/lost-0-1").mkdir(parents=True)
    (tmp_path / "out/_staged/lost-0-1/x.fits").write_bytes(b"half")
    export.remove_staged(str(tmp_path / "out"))
    assert sorted(os.listdir(tmp_path / "out")) == ["x.fits", "y.fits"]


def test_a_lost_task_leaves_no_half_file_and_no_second_copy(tmp_path, spark):
    """A task that dies while it copies, and one that dies after it has given names: the export run again has each file once."""
    paths = [put(tmp_path, f"a/{i}.fits", b"x" * 1000) for i in range(6)]
    df, target = spark.createDataFrame([(p,) for p in paths], "path string").coalesce(1), str(tmp_path / "out")
    os.makedirs(target)
    plan = export.copy_files(df, target)
    marker = str(tmp_path / "died")

    def dies(rows):
        for n, row in enumerate(rows):
            if n == 3 and not os.path.exists(marker):
                open(marker, "w").close()
                raise RuntimeError("lost")
            yield row

    with pytest.raises(Exception, match="lost"):
        plan.rdd.mapPartitions(dies).collect()
    os.makedirs(os.path.join(target, "_staged/x"))
    open(os.path.join(target, "_staged/x/5.fits"), "wb").write(b"half")
    assert all(open(os.path.join(target, n), "rb").read() == b"x" * 1000 for n in os.listdir(target) if n != "_staged")
    stamps = {n: os.stat(os.path.join(target, n)).st_ino for n in os.listdir(target) if n != "_staged"}
    assert sorted(r["copied"] for r in plan.collect()) == [True] * 6
    export.remove_staged(target)
    assert sorted(os.listdir(target)) == sorted(os.path.basename(p) for p in paths)
    assert all(os.stat(os.path.join(target, n)).st_ino == i for n, i in stamps.items())


def test_header_columns_are_the_schema(spark):
    columns = with_header_columns(spark.createDataFrame([], SCANNED)).select(*[f.name for f in IMAGE_FILES.fields if f.name not in ("id", "library_id", "created_on", "updated_on")])
    kinds = {f.name: f.dataType for f in IMAGE_FILES.fields}
    assert {f.name: f.dataType for f in columns.schema.fields} == {c: kinds[c] for c in columns.columns}
    assert columns.select(F.count("*")).first()[0] == 0


def test_files_of_a_folder_are_shared_among_tasks(tmp_path, monkeypatch):
    monkeypatch.setattr(listing, "SHARE_FILES", 10)
    for i in range(45):
        (tmp_path / f"{i}.fits").write_bytes(b"")
    [(folder, deep, shares)] = listing.folders(str(tmp_path))
    assert (folder, deep, shares) == (str(tmp_path), False, 5)
    parts = [[f.path for f in listing.walk(folder, deep, share=(k, shares))] for k in range(shares)]
    assert sorted(sum(parts, [])) == sorted(str(p) for p in tmp_path.iterdir())
    assert max(map(len, parts)) < 30
