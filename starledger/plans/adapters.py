"""A catalogue seen in the star-schema tables, for queries without image files.

Each column is one SQL expression that Spark and DuckDB both read, so a query and its SQL start from the
same rows. Images are the events; objects, libraries, cameras and so on follow from their keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _d(x: str) -> str:
    return f"CAST({x} AS DOUBLE)"


IMAGES = {
    "id": "event_id",
    "library_id": "CAST(user_id % 4 + 1 AS INT)",
    "header_hash": "sha1(CAST(CASE WHEN event_id % 10 = 9 THEN event_id - 9 ELSE event_id END AS STRING))",
    "path": "concat('/data/lib', CAST(user_id % 4 + 1 AS STRING), '/', event_type, '/IMG_', CAST(event_id AS STRING), '.fits')",
    "file_size": "event_id * 17 + 2880",
    "created_on": "ts",
    "updated_on": "CASE WHEN event_id < 0 THEN ts END",
    "type": "CAST(CASE WHEN event_id % 10 < 6 THEN 1 ELSE event_id % 5 END AS INT)",
    "kind": "CAST(CASE WHEN event_id % 9 < 5 THEN 1 WHEN event_id % 9 < 7 THEN 2 ELSE event_id % 6 END AS INT)",
    "camera_name": "CASE user_id % 3 WHEN 0 THEN 'Cam_A 100%' WHEN 1 THEN concat('cam B', chr(92), 'x') ELSE NULL END",
    "exposure": "CASE WHEN event_id % 97 = 0 THEN NULL ELSE value END",
    "camera_temperature_set_point": _d("event_id % 4 * 5 - 20"),
    "camera_temperature": f"value / {_d('10')} - {_d('20')}",
    "camera_gain": "CAST(event_id % 300 AS INT)",
    "camera_offset": "CAST(event_id % 50 AS INT)",
    "binning": "CAST(event_id % 4 + 1 AS INT)",
    "pixel_size": _d("event_id % 5 + 2"),
    "readout_mode": "CASE event_id % 2 WHEN 0 THEN 'High Gain' ELSE 'low noise' END",
    "focuser_name": "CASE event_id % 3 WHEN 0 THEN 'EAF' WHEN 1 THEN 'Eaf 2' ELSE NULL END",
    "focuser_position": "CAST(event_id % 12000 AS INT)",
    "focuser_temperature": f"value / {_d('20')}",
    "rotator_name": "CASE event_id % 3 WHEN 0 THEN 'Falcon' WHEN 1 THEN 'CAA' ELSE NULL END",
    "rotator_position": _d("event_id * 13 % 360"),
    "filter_wheel_name": "CASE event_id % 2 WHEN 0 THEN 'EFW 7x36' ELSE 'efw 5x2' END",
    "filter_name": "CASE WHEN event_id % 50 = 0 THEN NULL WHEN event_id % 50 = 1 THEN 'None' WHEN event_id % 50 = 2 THEN upper(event_type) WHEN event_id % 50 = 3 THEN ' ' ELSE event_type END",
    "right_ascension": f"{_d('event_id * 7 % 3600')} / {_d('10')}",
    "declination": f"{_d('event_id * 11 % 1800')} / {_d('10')} - {_d('90')}",
    "altitude": _d("event_id % 90"),
    "azimuth": _d("event_id * 11 % 360"),
    "telescope_name": "CASE user_id % 4 WHEN 0 THEN 'Newton 8' WHEN 1 THEN 'newton 10' WHEN 2 THEN 'RASA' ELSE NULL END",
    "focal_length": _d("event_id % 5 * 100 + 400"),
    "airmass": f"{_d('event_id % 100')} / {_d('100')} + {_d('1')}",
    "observation_timestamp_utc": "ts",
    "observation_timestamp_local": "CASE WHEN event_id % 4 = 0 THEN NULL ELSE ts - INTERVAL '5' HOUR END",
    "object_name": "CASE WHEN user_id % 10 = 0 THEN NULL WHEN user_id % 10 = 1 AND event_id % 2 = 0 THEN 'Élan' WHEN user_id % 10 = 1 THEN 'élan' WHEN event_id % 2 = 0 THEN concat('M ', CAST(user_id % 40 AS STRING)) ELSE concat('m ', CAST(user_id % 40 AS STRING)) END",
    "latitude": _d("user_id % 60"),
    "longitude": _d("user_id * 5 % 360 - 180"),
    "elevation": _d("user_id * 9 % 3000"),
    "dew_point": _d("event_id % 30 - 10"),
    "humidity": _d("event_id % 100"),
    "pressure": _d("event_id % 100 + 950"),
    "temperature": _d("event_id % 45 - 15"),
}
LIBRARIES = {"id": "r_regionkey + 1", "name": "r_name", "path": "concat('/data/lib', CAST(r_regionkey + 1 AS STRING))"}
TAGS = {"id": "s_suppkey", "name": "s_name", "color": "'#ffffffff'"}
IMAGE_TAGS = {"image_id": "l_orderkey", "tag_id": "l_suppkey"}
ALIASES = {"id": "n_nationkey", "object_name": "concat('M ', CAST(n_nationkey AS STRING))", "alias": "n_name"}

#: Each table: its columns, the table it is seen in, and whether rows are taken once.
VIEWS = {"images": (IMAGES, "events", False), "libraries": (LIBRARIES, "region", False), "tags": (TAGS, "supplier", False), "image_tags": (IMAGE_TAGS, "lineitem", True), "aliases": (ALIASES, "nation", False)}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A catalogue table as a DataFrame."""
    columns, source, once = VIEWS[name]
    df = spark.read.parquet(f"{sf_dir}/{source}.parquet").selectExpr(*[f"{e} AS `{c}`" for c, e in columns.items()])
    return df.distinct() if once else df


def with_views(sql: str) -> str:
    """SQL with the catalogue tables as common table expressions."""
    parts = [f"{n} AS (SELECT {'DISTINCT ' if once else ''}{', '.join(f'{e} AS {c}' for c, e in columns.items())} FROM {source})" for n, (columns, source, once) in VIEWS.items()]
    return f"WITH {', '.join(parts)} {sql}"
