"""Angles and times of observations."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F


def degrees_of_hours(hours: Column) -> Column:
    return hours * 15.0


def hours_of_degrees(degrees: Column) -> Column:
    return degrees / 15.0


def clamped(col: Column, low: float, high: float) -> Column:
    """Null stays null."""
    return F.when(col.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), col)))


def observed(local: str = "observation_timestamp_local", utc: str = "observation_timestamp_utc") -> Column:
    """The local time of an observation, or else its UTC time."""
    return F.coalesce(F.col(local), F.col(utc))


def night(fmt: str) -> Column:
    """The bucket of an observation: its time 12 hours back, so a night is one day. ``fmt``: a Java date pattern."""
    return F.date_format(observed() - F.expr("INTERVAL 12 HOURS"), fmt)


def end_of_day(day: dt.date | dt.datetime) -> dt.datetime:
    """The last millisecond of a day, up to which an end date reaches."""
    return dt.datetime(day.year, day.month, day.day, 23, 59, 59, 999000)


def local_of_utc(col: Column, zone: str) -> Column:
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), col)


def utc_of_local(col: Column, zone: str) -> Column:
    return F.convert_timezone(F.lit(zone), F.lit("UTC"), col)


def seconds_of_interval(col: Column) -> Column:
    """A day-time interval as seconds."""
    return F.unix_micros(F.timestamp_seconds(F.lit(0)) + col) / 1e6


def interval_of_seconds(col: Column) -> Column:
    return F.make_dt_interval(secs=col)


#: Bits by axis of the cells of the sky, and of the zones that they lie in.
CELL_BITS, ZONE_BITS = 12, 4


def _axis(degrees: float, low: float, width: float, bits: int = CELL_BITS) -> int:
    """The slice of an axis that an angle lies in; angles beyond its ends lie in the first or last."""
    return min((1 << bits) - 1, max(0, int((degrees - low) * (1 << bits) / width // 1)))


def sky_cell(right_ascension: Column, declination: Column) -> Column:
    """The Z-order number of a point's cell: the bits of its slices of right ascension and declination in turn. Null without coordinates."""

    def slice_of(degrees: Column, low: float, width: float) -> Column:
        return F.floor(F.greatest(F.lit(0.0), F.least(F.lit(float((1 << CELL_BITS) - 1)), (degrees - low) * (1 << CELL_BITS) / width))).cast("int")

    def spread(x: Column) -> Column:
        for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
            x = x.bitwiseOR(F.shiftleft(x, shift)).bitwiseAND(F.lit(mask))
        return x

    known = right_ascension.isNotNull() & declination.isNotNull() & ~F.isnan(right_ascension) & ~F.isnan(declination)
    return F.when(known, spread(slice_of(right_ascension, 0.0, 360.0)).bitwiseOR(F.shiftleft(spread(slice_of(declination, -90.0, 180.0)), 1)))


def sky_zone(cell: Column) -> Column:
    """The zone of a cell, -1 without one."""
    return F.coalesce(F.shiftright(cell, 2 * (CELL_BITS - ZONE_BITS)), F.lit(-1))


def cell_ranges(ra: tuple[float, float], dec: tuple[float, float], most: int) -> list[tuple[int, int]]:
    """At most ``most`` ranges of cells that hold a box, by quartering the sky where the box only cuts a quarter, coarse quarters first."""
    x, y = (tuple(_axis(d, low, width) for d in ends) for ends, low, width in ((ra, 0.0, 360.0), (dec, -90.0, 180.0)))

    def join(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
        out: list[list[int]] = []
        for low, high in sorted(ranges):
            if out and low <= out[-1][1] + 1:
                out[-1][1] = max(out[-1][1], high)
            else:
                out.append([low, high])
        return [(a, b) for a, b in out]

    level, done, best = [(0, 0, CELL_BITS, 0)], [], [(0, (1 << 2 * CELL_BITS) - 1)]
    while level:
        below = []
        for x0, y0, bits, first in level:
            side = 1 << bits
            if x0 > x[1] or x0 + side <= x[0] or y0 > y[1] or y0 + side <= y[0]:
                continue
            if bits == 0 or x[0] <= x0 and x0 + side - 1 <= x[1] and y[0] <= y0 and y0 + side - 1 <= y[1]:
                done.append((first, first + (1 << 2 * bits) - 1))
            else:
                half, quarter = side >> 1, 1 << 2 * (bits - 1)
                below += [(x0 + dx * half, y0 + dy * half, bits - 1, first + (dx + 2 * dy) * quarter) for dy in (0, 1) for dx in (0, 1)]
        hits = [(f, f + (1 << 2 * b) - 1) for x0, y0, b, f in below if not (x0 > x[1] or x0 + (1 << b) <= x[0] or y0 > y[1] or y0 + (1 << b) <= y[0])]
        cover = join(done + hits)
        if len(cover) > most:
            return best
        best, level = cover, below
    return best
