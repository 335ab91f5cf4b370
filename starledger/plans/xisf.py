"""XISF headers as column expressions: hash, shape and typed items of files held in a binary column.

All of it runs in the JVM. ``content`` is a file, or as many of its first bytes as the header needs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import parsed_float, parsed_int
from ..schema import HEADER
from ..sources.xisf import CHUNK, INTEGERS, MAGIC, PREAMBLE, REALS

_XML = "Image array<struct<_geometry: string, FITSKeyword: array<struct<_name: string, _value: string, _comment: string>>, Property: array<struct<_id: string, _type: string, _value: string, _VALUE: string>>>>"
_XML_OPTIONS = {"ignoreNamespace": "true", "valueTag": "_TEXT", "ignoreSurroundingSpaces": "false", "mode": "PERMISSIVE"}


def is_xisf(content: Column) -> Column:
    return (F.octet_length(content) >= PREAMBLE) & (F.substring(content, 1, len(MAGIC)) == F.lit(MAGIC))


def header_length(content: Column) -> Column:
    """Bytes of the XML text behind the preamble, as far as the file has them: a signed little-endian number."""
    digits = F.hex(F.substring(content, 9, 4))
    told = F.conv(F.concat(*[F.substring(digits, i, 2) for i in (7, 5, 3, 1)]), 16, 10).cast("bigint")
    return F.when(told >= 1 << 31, F.lit(0)).otherwise(F.least(told, F.octet_length(content) - PREAMBLE)).cast("int")


def header_hash(content: Column, compat: bool = False, length: Column | None = None) -> Column:
    """SHA-1 of the XML text; ``compat``: over whole chunks of 8 KiB, the last of them as far as the file goes and then its header part again."""
    length = header_length(content) if length is None else length
    text = F.substr(content, F.lit(PREAMBLE + 1), length)
    if not compat:
        return F.sha1(text)
    before = (F.floor((F.greatest(length, F.lit(1)) - 1) / CHUNK) * CHUNK).cast("int")
    whole = F.substr(content, F.lit(PREAMBLE + 1), F.when(length > 0, before + CHUNK).otherwise(F.lit(0)))
    return F.sha1(F.concat(whole, F.substr(content, F.lit(PREAMBLE + 1) + before, length - before)))


def typed_value(raw: Column) -> Column:
    """(kind, s, b, i, d) of a keyword's value by how it looks: t or f, integer, real, complex (null), else text, whose quotes are stripped."""
    logical, whole, real = F.lower(raw).isin("t", "f"), parsed_int(raw), parsed_float(raw)
    text = F.when(raw.startswith("'"), F.substr(F.replace(raw, F.lit("''"), F.lit("'")), F.lit(2), F.greatest(F.lit(0), F.length(F.replace(raw, F.lit("''"), F.lit("'"))) - 2))).otherwise(raw)
    return (
        F.when(logical, _typed("bool", b=F.lower(raw) == "t"))
        .when(whole.isNotNull(), _typed("int", i=whole))
        .when(real.isNotNull(), _typed("float", d=real))
        .when(raw.startswith("(") & raw.endswith(")") & raw.contains(","), F.lit(None))
        .otherwise(_typed("string", s=text))
    )


def typed_property(kind: Column, value: Column, text: Column) -> Column:
    """(kind, s, b, i, d) of a property by its type; null where the type isn't one of a single value or the value doesn't fit."""
    return (
        F.when(kind == "String", _typed("string", s=F.coalesce(F.when(text != "", text), value, F.lit(""))))
        .when(kind == "Boolean", F.when(value.isNotNull(), _typed("bool", b=value == "1")))
        .when(kind.isin(*INTEGERS) & parsed_int(value).isNotNull(), _typed("int", i=parsed_int(value)))
        .when(kind.isin(*REALS) & parsed_float(value).isNotNull(), _typed("float", d=parsed_float(value)))
    )


def _typed(kind: str, s: Column | None = None, b: Column | None = None, i: Column | None = None, d: Column | None = None) -> Column:
    given = {"s": (s, "string"), "b": (b, "boolean"), "i": (i, "int"), "d": (d, "double")}
    return F.struct(F.lit(kind).alias("kind"), *[(F.lit(None) if c is None else c).cast(t).alias(n) for n, (c, t) in given.items()])


def _item(keyword: Column, value: Column, comment: Column) -> Column:
    return F.struct(F.coalesce(keyword, F.lit("")).alias("keyword"), value["kind"].alias("kind"), *[value[c].alias(c) for c in "sbid"], comment.cast("string").alias("comment"))


def _text(content: Column, length: Column) -> Column:
    """The XML text without what pads it; null if it isn't UTF-8."""
    raw = F.try_validate_utf8(F.substr(content, F.lit(PREAMBLE + 1), length).cast("string"))
    return F.rtrim(F.when(raw.contains("\0"), F.translate(raw, "\0", " ")).otherwise(raw))  # translating goes letter by letter


def _image(text: Column, schema: str = _XML) -> Column:
    """The first image of an XML text; null if that can't be read."""
    return F.get(F.from_xml(text, schema.replace("_VALUE", "_TEXT"), _XML_OPTIONS)["Image"], F.lit(0))


def xisf_header(content: Column) -> Column:
    """The header struct of the first image of a file; without items if its XML can't be read.

    Keywords come before properties, each in the order of the file.
    """
    return _header(_text(content, header_length(content)))


def _header(text: Column) -> Column:
    return _bound(_image(text), _header_of)  # so that the text is parsed once


def _shape_of(geometry: Column) -> list[Column]:
    """Width and height."""
    shape = F.split(geometry, ":")
    return [F.when(F.size(shape) == 3, parsed_int(F.get(shape, F.lit(i)))) for i in (0, 1)]


def _keyword_value(name: Column, raw: Column) -> Column:
    empty = lambda c: F.coalesce(c, F.lit(""))
    return F.when(empty(name).isin("COMMENT", "HISTORY"), _typed("string", s=F.lit(""))).otherwise(typed_value(empty(raw)))


def _header_of(image: Column) -> Column:
    def keyword(e: Column) -> Column:
        return _bound(_keyword_value(e["_name"], e["_value"]), lambda v: _item(e["_name"], v, F.coalesce(e["_comment"], F.lit(""))))

    def prop(e: Column) -> Column:
        return _bound(typed_property(e["_type"], e["_value"], e["_TEXT"]), lambda v: _item(e["_id"], v, F.lit(None)))

    none = F.array().cast(HEADER["items"].dataType)
    every = F.concat(*[F.coalesce(F.transform(image[c], f).cast(HEADER["items"].dataType), none) for c, f in (("FITSKeyword", keyword), ("Property", prop))])
    shape = _shape_of(image["_geometry"])
    return F.struct(shape[0].alias("width"), shape[1].alias("height"), F.lit(".xisf").alias("file_extension"), F.filter(every, lambda e: e["kind"].isNotNull()).alias("items"))


def _bound(value: Column, use) -> Column:
    """``use(x)`` with x worked out once."""
    return F.transform(F.array(value), use)[0]


# Lambdas over arrays aren't compiled, and an operator that has one evaluates all it does step by step, and each repeated part
# again. So lengths, texts and images are columns of their own, and rows of items are typed after they are taken apart.


def _named(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def _with_length(df: DataFrame, content: str) -> DataFrame:
    """``df`` with _length, null where the file isn't XISF."""
    c = F.col(content)
    return df.withColumn("_length", F.when(is_xisf(c), header_length(c)))


def read_xisf(df: DataFrame, content: str = "content", compat: bool = False) -> DataFrame:
    """``df`` with header_hash, header and error of a column of XISF files; other columns of these names are replaced."""
    c, length = F.col(content), F.col("_length")
    good = length.isNotNull()
    hashed = _with_length(df, content).withColumns({"header_hash": F.when(good, header_hash(c, compat, length)), "error": F.when(~good, F.lit("HeaderError: not an XISF file")), "_text": _text(c, length)})
    names = dict.fromkeys([*df.columns, "header_hash", "header", "error"])
    return hashed.withColumn("header", F.when(good, _header(F.col("_text")))).select(*[_named(n) for n in names])


def xisf_shapes(df: DataFrame, content: str = "content") -> DataFrame:
    """``df`` with header_hash, compat_hash, width, height and error, as ``read_xisf`` gives them, for readers that need no items; other columns of these names are replaced."""
    c, length = F.col(content), F.col("_length")
    geometry = _image(_text(c, length), "Image array<struct<_geometry: string>>")["_geometry"]
    good = length.isNotNull()
    read = _with_length(df, content).withColumns({"header_hash": F.when(good, header_hash(c, False, length)), "compat_hash": F.when(good, header_hash(c, True, length)), "error": F.when(~good, F.lit("HeaderError: not an XISF file")), "_geometry": geometry})
    shape = _shape_of(F.col("_geometry"))
    return read.withColumns({"width": shape[0], "height": shape[1]}).drop("_length", "_geometry")


def xisf_items(df: DataFrame, content: str = "content") -> DataFrame:
    """The items of ``read_xisf`` as rows: the other columns of ``df``, position (from 0, rising, with gaps) and the item's columns.

    Files that aren't XISF and those without items have no row.
    """
    kept = [_named(n) for n in df.columns if n != content]
    texts = _with_length(df, content).select(*kept, _text(F.col(content), F.col("_length")).alias("_text"))
    images = texts.select(*kept, _image(F.col("_text")).alias("_image"))
    keywords, properties = (F.coalesce(F.col("_image")[n], F.array()) for n in ("FITSKeyword", "Property"))
    # Outer: an inner one would parse each file for its filter too.
    pairs = images.select(*kept, F.size(keywords).alias("_keywords"), F.posexplode_outer(F.arrays_zip(keywords.alias("keyword"), properties.alias("property"))).alias("_at", "_pair"))
    k, p = F.col("_pair.keyword"), F.col("_pair.property")
    typed = pairs.select(*kept, "_keywords", "_at", "_pair", F.when(k.isNotNull(), _keyword_value(k["_name"], k["_value"])).alias("_k"), F.when(p.isNotNull(), typed_property(p["_type"], p["_value"], p["_TEXT"])).alias("_p"))
    items = F.array(
        F.struct(F.col("_at").alias("position"), _item(k["_name"], F.col("_k"), F.coalesce(k["_comment"], F.lit(""))).alias("_item")),
        F.struct((F.col("_keywords") + F.col("_at")).alias("position"), _item(p["_id"], F.col("_p"), F.lit(None)).alias("_item")),
    )
    return typed.select(*kept, F.inline(items)).where("_item.kind is not null").select(*kept, "position", "_item.*")
