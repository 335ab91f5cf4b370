"""Catalogue tables and code values."""

from __future__ import annotations

from pyspark.sql import types as T

#: Codes of the image type and image kind columns.
IMAGE_TYPES = {"Unknown": 0, "Light": 1, "Flat": 2, "Dark": 3, "Bias": 4}
IMAGE_KINDS = {"Unknown": 0, "Raw": 1, "Intermediate": 2, "Calibration": 3, "Master": 4, "Processed": 5}


_TYPES = {"bigint": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "string": T.StringType(), "boolean": T.BooleanType(), "timestamp_ntz": T.TimestampNTZType()}


def _struct(columns: str) -> T.StructType:
    """Nullable columns of plain types, without a session."""
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in (c.split() for c in columns.split(", "))])


#: What a file's header yields; every column may be null.
HEADER_COLUMNS = (
    "camera_name string, exposure double, camera_temperature_set_point double, camera_temperature double, camera_gain int, camera_offset int, binning int, pixel_size double, readout_mode string, "
    "focuser_name string, focuser_position int, focuser_temperature double, rotator_name string, rotator_position double, filter_wheel_name string, filter_name string, "
    "right_ascension double, declination double, altitude double, azimuth double, telescope_name string, focal_length double, airmass double, "
    "observation_timestamp_utc timestamp_ntz, observation_timestamp_local timestamp_ntz, object_name string, latitude double, longitude double, elevation double, "
    "dew_point double, humidity double, pressure double, temperature double"
)
IMAGE_FILES = _struct("id bigint, library_id int, header_hash string, path string, file_size bigint, created_on timestamp_ntz, updated_on timestamp_ntz, type int, kind int, " + HEADER_COLUMNS)
LIBRARIES = _struct("id int, created_on timestamp_ntz, updated_on timestamp_ntz, name string, path string, last_scan timestamp_ntz")
TAGS = _struct("id int, created_on timestamp_ntz, updated_on timestamp_ntz, name string, color string")
IMAGE_FILE_TAG = _struct("image_id bigint, tag_id int")
OBJECT_ALIASES = _struct("id int, object_name string, alias string")
APP_SETTINGS = _struct("id int, persist_filters_on_exit boolean, use_intermediate_frames_for_plots boolean, full_screen boolean")
ASTROBIN_FILTERS = _struct("id int, app_settings_id int, astrobin_id int, name string")
PERSISTED_FILTERS = _struct("id int, app_settings_id int, name string, data string")

TABLES = {
    "image_files": IMAGE_FILES,
    "libraries": LIBRARIES,
    "tags": TAGS,
    "image_file_tag": IMAGE_FILE_TAG,
    "object_aliases": OBJECT_ALIASES,
    "app_settings": APP_SETTINGS,
    "astrobin_filters": ASTROBIN_FILTERS,
    "persisted_filters": PERSISTED_FILTERS,
}

#: One value of a header: exactly one of ``s b i d`` is set, by ``kind`` (string, bool, int, float).
HEADER_ITEM = _struct("keyword string, kind string, s string, b boolean, i int, d double, comment string")
HEADER = T.StructType([T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType()), T.StructField("file_extension", T.StringType()), T.StructField("items", T.ArrayType(HEADER_ITEM))])
#: What the header source gives for each file.
SCANNED = T.StructType([*_struct("path string, file_size bigint, modified timestamp_ntz, created timestamp_ntz, header_hash string").fields, T.StructField("header", HEADER), T.StructField("error", T.StringType())])
