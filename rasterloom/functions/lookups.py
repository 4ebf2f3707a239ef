"""Parsing and lookups as Column functions: metadata with fallbacks, keyword classes, identifiers, sensor scalings, bits."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from rasterloom.functions.masks import sure

# First and last day of the season by kind of bog.
SEASONS = {"raised": ("04-01", "06-15"), "blanket": ("04-15", "06-30")}
# Keywords of each class of note, in order of precedence.
NOTES = (
    ("dry or dead vegetation", ("dead", "dry grass", "senescent", "molinia", "straw", "bleached", "withered")),
    ("track or road", ("track", "road", "gravel")),
    ("revegetating cutaway", ("revegetat",)),
    ("mixed pixel at a cut face or strip edge", ("edge", "margin", "beside", "adjacent", "nearby", "just ", "between", "next to", "mixed", "boundary", "border")),
)


def first_listed(names: Column, allowed: list[str]) -> Column:
    """The first of a comma-separated list that is among those allowed, NULL without any."""
    return F.try_element_at(F.filter(F.transform(F.split(names, ","), lambda x: F.trim(x)), lambda x: x.isin(*allowed)), F.lit(1))


def sun(azimuth: Column, other_azimuth: Column, zenith: Column, elevation: Column) -> tuple[Column, Column]:
    """Azimuth and zenith in degrees from two spellings of each; both NULL unless both are known."""
    az, zen = F.coalesce(azimuth, other_azimuth), F.coalesce(zenith, 90 - elevation)
    known = az.isNotNull() & zen.isNotNull()
    return F.when(known, az), F.when(known, zen)


def season(year: Column, kind: Column) -> Column:
    """first/last day of the season of a kind of bog; unknown kinds as raised ones."""
    first, last = (F.create_map(*[F.lit(x) for k, v in SEASONS.items() for x in (k, v[i])]) for i in (0, 1))
    own = F.when(kind.isin(*SEASONS), kind).otherwise("raised")
    y = year.cast("string")
    return F.concat(y, F.lit("-"), F.try_element_at(first, own), F.lit("/"), y, F.lit("-"), F.try_element_at(last, own))


def note_class(note: Column, other: str = "other") -> Column:
    """The first class of which a note holds a keyword."""
    low, out = F.lower(F.coalesce(note, F.lit(""))), F.lit(other)
    for name, words in reversed(NOTES):
        hit = F.lit(False)
        for w in words:
            hit = hit | low.contains(w)
        out = F.when(hit, name).otherwise(out)
    return out


def fate(ndvi: Column, green: float = 0.50, bare: float = 0.35) -> Column:
    """What became of a pixel by summer; one that is not seen is unseen, never bare."""
    return F.when(ndvi.isNull() | F.isnan(ndvi), "unseen").when(ndvi >= green, "green").when(ndvi < bare, "bare").otherwise("between")


def stem(point: Column) -> Column:
    """Identifier of a scene from that of a point: what stands before the last _r."""
    return F.regexp_extract(point, r"^(?s:(.*))_r", 1)


def point_parts(point: Column) -> tuple[Column, Column, Column]:
    """Stem, row and column of a point named <stem>_r<row>_c<column>; NULL for other names."""
    pattern = r"^(.+)_r(\d+)_c(\d+)$"
    ok = point.rlike(pattern)
    return F.when(ok, F.regexp_extract(point, pattern, 1)), F.when(ok, F.regexp_extract(point, pattern, 2).try_cast("int")), F.when(ok, F.regexp_extract(point, pattern, 3).try_cast("int"))


def landsat_reflectance(dn: Column) -> Column:
    """Digital number of a level-2 surface band to reflectance x 10000."""
    return (dn * 0.0000275 - 0.2) * 10000


def landsat_seen(stack: list[Column], blue: Column) -> Column:
    """Whether no band lies in a scan-line gap, which reads as zero."""
    ok = blue != -2000
    for b in stack:
        ok = ok & (b > -1000)
    return sure(ok)


def surface_celsius(st: Column) -> Column:
    """Temperature of a thermal band; no data is 0 or less."""
    return F.when(st > 0, st * 0.00341802 + 149.0 - 273.15)


def decibel(power: Column) -> Column:
    """Backscatter in decibels, NULL for no data and border noise."""
    return F.when(~F.isnan(power) & (power > 1e-4), 10 * F.log10(power))


def footprint(instrument: Column) -> Column:
    """Nominal pixel of a thermal sensor in metres."""
    return F.when(F.upper(instrument).contains("MODIS"), 1000).otherwise(375)


def swir_stretch(x: Column, gain: float = 2.5) -> Column:
    """Display value of a short-wave composite."""
    return F.pow(F.least(F.greatest(x * gain, F.lit(0.0)), F.lit(1.0)), F.lit(1 / 1.2))


@F.pandas_udf(BinaryType())
def packed_bits(flags: pd.Series) -> pd.Series:
    """An array of flags, eight to a byte, first flag highest."""
    import numpy as np

    return flags.map(lambda x: None if x is None else np.packbits(np.asarray(x, bool)).tobytes())


def bit_at(packed: Column, at: Column) -> Column:
    """The flag at a place of a packed mask: its byte in hexadecimal, its bit by a shift."""
    byte = F.conv(F.substring(F.hex(packed), (F.floor(at / 8) * 2 + 1).cast("int"), F.lit(2)), 16, 10).cast("int")
    return F.expr("1") == F.call_function("shiftright", byte, (7 - at % 8).cast("int")).bitwiseAND(1)
