"""Scalar functions as Column expressions; none leaves the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# GRS80, the transverse Mercator grid of zone 17 north, and the sanity bound of northings.
SEMI_MAJOR, FLATTENING = 6378137.0, 1 / 298.257222101
CENTRAL_MERIDIAN, SCALE, FALSE_EASTING = -81.0, 0.9996, 500000.0
LEAST_NORTHING = 4_000_000.0
#: How numbers are written: a cast alone would take Java's suffixes (12D) and NaN too.
WHOLE, DECIMAL = r"^[+-]?[0-9]+$", r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def strip(c: Column) -> Column:
    """Without Unicode white space at both ends (``trim`` knows the blank only)."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def folded(c: Column) -> Column:
    return F.lower(strip(c))


def label(c: Column, *cases: tuple[Sequence[str], int]) -> Column:
    """The number of the first word list that has the folded value; null where none has it."""
    word = folded(c)
    out = None
    for words, value in cases:
        hit = word.isin(list(words))
        out = F.when(hit, F.lit(value)) if out is None else out.when(hit, F.lit(value))
    return out.cast("tinyint")


def appeal_label(c: Column, appealed: Sequence[str], approved: Sequence[str]) -> Column:
    """1 if an appeal was filed, 0 if approved without one, else null."""
    quiet = [w for w in approved if w not in set(appealed)]
    return label(c, (appealed, 1), (quiet, 0))


def year_or_zero(date: Column) -> Column:
    return F.coalesce(F.year(date), F.lit(0))


def leading_year(text: Column) -> Column:
    """The first four characters as a number; null where they are none."""
    return F.substring(text, 1, 4).try_cast("int")


def days_between(start: Column, end: Column) -> Column:
    return F.datediff(end, start)


def days_if(flag: Column, start: Column, end: Column) -> Column:
    """Days from start to end where the flag is 1, else null."""
    return F.when(flag == 1, days_between(start, end))


def present_flag(c: Column) -> Column:
    """1 where there is a value, an empty string included."""
    return c.isNotNull().cast("tinyint")


def number(text: Column) -> Column:
    """The number that a text is in decimal digits; null for all else, as ``12D`` or ``NaN``."""
    return F.when(text.rlike(DECIMAL), text.try_cast("double"))


def usable_northing(y: Column) -> Column:
    return y.isNotNull() & (y >= LEAST_NORTHING)


def grid_to_lonlat(easting: Column, northing: Column) -> tuple[Column, Column]:
    """Longitude and latitude of grid coordinates, by the inverse Krueger series to third order.

    Null where a coordinate is null or the northing is below the sanity bound.
    """
    n = FLATTENING / (2 - FLATTENING)
    radius = SEMI_MAJOR / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    beta = (n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480)
    delta = (2 * n - 2 * n**2 / 3 - 2 * n**3, 7 * n**2 / 3 - 8 * n**3 / 5, 56 * n**3 / 15)
    xi = northing / F.lit(SCALE * radius)
    eta = (easting - F.lit(FALSE_EASTING)) / F.lit(SCALE * radius)
    north, east = xi, eta
    for k, b in enumerate(beta, 1):
        north = north - F.lit(b) * F.sin(xi * (2.0 * k)) * F.cosh(eta * (2.0 * k))
        east = east - F.lit(b) * F.cos(xi * (2.0 * k)) * F.sinh(eta * (2.0 * k))
    chi = F.asin(F.sin(north) / F.cosh(east))
    lat = chi
    for k, d in enumerate(delta, 1):
        lat = lat + F.lit(d) * F.sin(chi * (2.0 * k))
    lon = F.lit(CENTRAL_MERIDIAN) + F.degrees(F.atan2(F.sinh(east), F.cos(north)))
    usable = easting.isNotNull() & usable_northing(northing)
    return F.when(usable, lon), F.when(usable, F.degrees(lat))
