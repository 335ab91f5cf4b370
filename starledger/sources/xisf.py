"""XISF headers: a 16-byte preamble and an XML text, nothing behind them."""

from __future__ import annotations

import hashlib
import struct
from typing import BinaryIO
from xml.etree import ElementTree

from .fits import HeaderError
from .values import item, parse_float, parse_int, typed_by_look

MAGIC, PREAMBLE, CHUNK = b"XISF0100", 16, 8192
# The property types of the format that hold one number.
INTEGERS = frozenset("Int8 UInt8 Byte Int16 UInt16 Short UShort Int32 UInt32 Int UInt Int64 UInt64".split())
REALS = frozenset("Float32 Float64 Float Double".split())
# End of fixed values.


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def compat_hash(stream: BinaryIO, length: int) -> str:
    """SHA-1 over 8 KiB chunks, the last of them whole and then its header part again."""
    digest, at = hashlib.sha1(), 0
    while at < length and (chunk := stream.read(CHUNK)):
        digest.update(chunk)
        if at + len(chunk) >= length:
            digest.update(chunk[: length - at])
        at += len(chunk)
    return digest.hexdigest()


def _keyword(element) -> dict | None:
    name, raw, comment = (element.get(k, "") for k in ("name", "value", "comment"))
    if name in ("COMMENT", "HISTORY"):
        return item(name, "", comment)
    value = typed_by_look(raw)
    return None if value is None else item(name, value, comment)


def _property(element) -> dict | None:
    name, kind, value = element.get("id", ""), element.get("type", ""), element.get("value")
    if kind == "String":
        return item(name, element.text or value or "")
    if value is None:
        return None
    if kind == "Boolean":
        return item(name, value == "1")
    number = parse_int(value) if kind in INTEGERS else parse_float(value) if kind in REALS else None
    return None if number is None else item(name, number)


def read_header(stream: BinaryIO, compat_xisf_hash: bool = False) -> tuple[dict, str]:
    """Header and hash of an XISF file; an unreadable XML text gives a header without items."""
    preamble = stream.read(PREAMBLE)
    if len(preamble) < PREAMBLE or preamble[:8] != MAGIC:
        raise HeaderError("not an XISF file")
    length = max(0, struct.unpack("<i", preamble[8:12])[0])
    text = stream.read(length)
    if compat_xisf_hash:
        stream.seek(PREAMBLE)
        digest = compat_hash(stream, len(text))
    else:
        digest = hashlib.sha1(text).hexdigest()
    header = {"width": None, "height": None, "file_extension": ".xisf", "items": []}
    try:
        root = ElementTree.fromstring(text.rstrip(b"\0").strip())
    except ElementTree.ParseError:
        return header, digest
    image = next((e for e in root.iter() if _local(e.tag) == "Image"), None)
    if image is None:
        return header, digest
    shape = image.get("geometry", "").split(":")
    if len(shape) == 3:
        header["width"], header["height"] = parse_int(shape[0]), parse_int(shape[1])
    for element in image:
        made = _keyword(element) if _local(element.tag) == "FITSKeyword" else _property(element) if _local(element.tag) == "Property" else None
        if made:
            header["items"].append(made)
    return header, digest
