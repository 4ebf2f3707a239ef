"""Spectral indices and stretches as Column functions. Bands are reflectance x 10000; no data is NULL, never NaN."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BANDS = ("blue", "green", "red", "nir", "swir1", "swir2")
EPSILON = 1e-9


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def clean(x: Column | str) -> Column:
    """NaN to NULL, so that no comparison takes it for the largest number."""
    return F.when(~F.isnan(col(x).cast("double")), col(x).cast("double"))


def ratio(a: Column | str, b: Column | str) -> Column:
    """(a - b) / (a + b), NULL where the sum is 0."""
    return F.try_divide(col(a) - col(b), col(a) + col(b))


def ratio_zero(a: Column | str, b: Column | str) -> Column:
    """(a - b) / (a + b), 0 where the sum is 0."""
    return F.when(col(a) + col(b) == 0, 0.0).otherwise(ratio(a, b))


def ratio_eps(a: Column | str, b: Column | str) -> Column:
    """(a - b) / (a + b + 1e-9), as the adaptive detectors use it."""
    return F.try_divide(col(a) - col(b), col(a) + col(b) + EPSILON)


def ndvi(red: str = "red", nir: str = "nir") -> Column:
    return ratio_zero(nir, red)


def brightness() -> Column:
    return (F.col("blue") + F.col("green") + F.col("red")) / 3 / 10000


def nbr() -> Column:
    return ratio("nir", "swir2")


def mndwi() -> Column:
    return ratio("green", "swir1")


def ndwi() -> Column:
    return ratio("green", "nir")


def swir_ratio() -> Column:
    return F.try_divide(F.col("swir1"), F.col("swir2"))


def features() -> Column:
    """The nine features of the cluster detectors: six bands, NDVI, MNDWI, NBR2."""
    return F.array(*[F.col(b) for b in BANDS], ratio_eps("nir", "red"), ratio_eps("green", "swir1"), ratio_eps("swir1", "swir2"))


def stretch(x: Column, gain: float = 3.2, gamma: float = 1.4) -> Column:
    """Display value in 0..1 of a reflectance."""
    return F.pow(F.least(F.greatest(x * gain, F.lit(0.0)), F.lit(1.0)), F.lit(1 / gamma))


def harmonised(dn: Column, baseline: Column, scale: Column, offset: Column, applied: Column, nodata: float = 0.0) -> Column:
    """Digital number to reflectance x 10000: metadata first, then a provider's flag, then the processing baseline."""
    dn = F.when((dn == nodata) | F.isnan(dn), None).otherwise(dn)
    by_meta = (dn * scale + offset) * 10000
    version = F.trim(baseline).try_cast("double")
    missing = F.raise_error(F.lit("processing baseline is missing or not a number")).cast("double")
    by_version = F.when(version.isNull(), missing).when(version >= 4.0, dn - 1000).otherwise(dn)
    out = F.when(scale.isNotNull() & offset.isNotNull(), by_meta).when(F.coalesce(applied, F.lit(False)), dn).otherwise(by_version)
    return F.greatest(out, F.when(out.isNotNull(), F.lit(0.0)))


def mixed(share: Column, inside: Column, outside: Column) -> Column:
    """Linear mixture of two spectra."""
    return share * inside + (1 - share) * outside


def strip_share(width: Column, pixel: float = 10.0) -> Column:
    """Share of a pixel that a strip of this width fills."""
    return F.least(width / pixel, F.lit(1.0))
