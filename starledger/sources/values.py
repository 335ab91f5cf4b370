"""Values of header keywords."""

from __future__ import annotations

import re
from typing import Any

_INT = re.compile(r"[+-]?\d+\Z")
_FLOAT = re.compile(r"[+-]?(?:\d+\.?\d*|\.\d+)(?:[Ee][+-]?\d+)?\Z")


def parse_int(raw: str) -> int | None:
    """A 32-bit integer, or None."""
    text = raw.strip()
    return int(text) if _INT.match(text) and -(2**31) <= int(text) < 2**31 else None


def parse_float(raw: str) -> float | None:
    """A real number, or None; the exponent may be marked by D."""
    text = raw.strip().replace("D", "E").replace("d", "e")
    return float(text) if _FLOAT.match(text) else None


def item(keyword: str, value: Any, comment: str | None = None) -> dict:
    """A header item; the Python type of the value sets its kind."""
    kind = {bool: "bool", int: "int", float: "float"}.get(type(value), "string")
    slot = {"string": "s", "bool": "b", "int": "i", "float": "d"}[kind]
    return {"keyword": keyword, "kind": kind, "s": None, "b": None, "i": None, "d": None, "comment": comment} | {slot: value}


def typed_by_look(raw: str) -> Any:
    """A value typed by how it looks: t or f, integer, real, complex (None), else text, whose quotes are stripped."""
    if raw.lower() in ("t", "f"):
        return raw.lower() == "t"
    number = parse_int(raw)
    if number is None:
        number = parse_float(raw)
    if number is not None:
        return number
    if raw.startswith("(") and raw.endswith(")") and "," in raw:
        return None
    return raw.replace("''", "'")[1:-1] if raw.startswith("'") else raw
