"""Reflectance and colour index expressions. Undefined results are NULL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Scene classes that are not ground: no data, saturated, shadow, cloud, cirrus, snow (fixed values).
MASKED_CLASSES = (0, 1, 3, 8, 9, 10, 11)
#: Bands of each normalised difference index (fixed values).
INDEX_BANDS = {"NDVI": ("b08", "b04"), "NDMI": ("b08", "b11"), "NDWI": ("b03", "b08")}
SMALLEST_DENOMINATOR = 1e-6


def clamp(x: Column, low: float, high: float) -> Column:
    """x kept between two bounds; NULL stays NULL."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def finite(x: Column) -> Column:
    """NaN and infinities as NULL."""
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def to_reflectance(raw: Column, scale: float = 1e-4, offset: float = -0.1, nodata: float = 0) -> Column:
    return F.when(raw != nodata, raw * F.lit(scale) + F.lit(offset))


def normalized_difference(a: Column, b: Column) -> Column:
    """(a - b) / (a + b), NULL for a vanishing sum or a result beyond 1 in size."""
    total = a + b
    value = F.when(F.abs(total) >= SMALLEST_DENOMINATOR, (a - b) / total)
    return F.when(F.abs(value) <= 1, value)


def spectral_index(name: str) -> Column:
    """A named index over band columns."""
    a, b = INDEX_BANDS[name]
    return normalized_difference(F.col(a), F.col(b))


def ground_class(scl: Column) -> Column:
    return ~scl.isin(*MASKED_CLASSES)


def observed(scl: Column, bands: list[Column], inside: Column) -> Column:
    """Inside the field, of a ground class, with all bands there."""
    out = inside & ground_class(scl)
    for band in bands:
        out = out & finite(band).isNotNull()
    return F.coalesce(out, F.lit(False))


def colour_indices(red: Column, green: Column, blue: Column) -> dict[str, Column]:
    """VARI, excess green and GLI of a pixel; black pixels have none."""
    total = red + green + blue
    lit = total > 0
    vari_den, gli_den = green + red - blue, 2 * green + red + blue
    vari = F.when(lit & (F.abs(vari_den) >= SMALLEST_DENOMINATOR), (green - red) / vari_den)
    return {
        "vari": F.when(F.abs(vari) <= 1.5, vari),
        "exg": F.when(lit, (2 * green - red - blue) / total),
        "gli": F.when(lit & (F.abs(gli_den) >= SMALLEST_DENOMINATOR), (2 * green - red - blue) / gli_den),
    }
