"""FITS headers: the primary header's cards, read in blocks of 2880 bytes, nothing behind them."""

from __future__ import annotations

import hashlib
import re
from typing import BinaryIO

from .values import item, parse_float, parse_int

BLOCK, CARD = 2880, 80
END = b"END".ljust(CARD)


class HeaderError(ValueError):
    """A file whose header can't be used."""


def read_cards(stream: BinaryIO) -> tuple[list[str], str]:
    """The cards before the end card, and the SHA-1 of their bytes."""
    cards, digest = [], hashlib.sha1()
    while len(block := stream.read(BLOCK)) >= CARD:
        for at in range(0, len(block) - CARD + 1, CARD):
            card = block[at : at + CARD]
            if card == END:
                return cards, digest.hexdigest()
            digest.update(card)
            cards.append(card.decode("latin-1"))
    raise HeaderError("no end of the header")


def _quoted(text: str) -> tuple[str, str] | None:
    """A quoted text at the start, trailing spaces off, and what follows it."""
    m = re.match(r"\s*'((?:[^']|'')*)'", text)
    return (m[1].replace("''", "'").rstrip(" "), text[m.end() :]) if m else None


def _comment(text: str) -> str | None:
    _, slash, comment = text.partition("/")
    return comment.strip() if slash else None


def parse_cards(cards: list[str]) -> list[dict]:
    """Items of the cards that have a value, in order; texts may go on in CONTINUE cards.

    Integers beyond 32 bits and values of no known form are skipped, as are commentary cards. A complex
    value makes the header unusable.
    """
    items, at = [], 0
    while at < len(cards):
        card = cards[at]
        at += 1
        if card.startswith("HIERARCH ") and "=" in card:
            keyword, _, rest = card[9:].partition("=")
        elif card[8:10] == "= ":
            keyword, rest = card[:8], card[10:]
        else:
            continue
        keyword = keyword.strip()
        text = _quoted(rest)
        if text:
            value, after = text
            comment = _comment(after)
            while value.endswith("&") and at < len(cards) and cards[at].startswith("CONTINUE") and (more := _quoted(cards[at][8:])):
                value, comment = value[:-1] + more[0], _comment(more[1]) or comment
                at += 1
            items.append(item(keyword, value, comment))
            continue
        raw = rest.partition("/")[0].strip()
        if raw in ("T", "F"):
            items.append(item(keyword, raw == "T", _comment(rest)))
        elif raw.startswith("("):
            raise HeaderError(f"complex value of {keyword}")
        elif re.match(r"[+-]?\d+\Z", raw):
            if (number := parse_int(raw)) is not None:
                items.append(item(keyword, number, _comment(rest)))
        elif (real := parse_float(raw)) is not None:
            items.append(item(keyword, real, _comment(rest)))
    return items


def read_header(stream: BinaryIO) -> tuple[dict, str]:
    """Header and hash of a FITS file."""
    cards, digest = read_cards(stream)
    items = parse_cards(cards)
    first = {i["keyword"]: i["i"] for i in reversed(items) if i["kind"] == "int"}
    return {"width": first.get("NAXIS1"), "height": first.get("NAXIS2"), "file_extension": ".fits", "items": items}, digest
