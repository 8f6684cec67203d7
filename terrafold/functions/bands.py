"""Pointwise band algebra on columns. Missing samples are null and stay null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Guards against division by zero and radiometric constants.
EPS = 1e-8
LANDSAT_SCALE, LANDSAT_OFFSET = 2.75e-05, -0.2
GREY_MASKS, GREY_FEATURES = (0.2989, 0.5870, 0.1140), (0.299, 0.587, 0.114)


def clip(x: Column, low: float, high: float) -> Column:
    """x within [low, high]; null stays null, which greatest and least alone would not give."""
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def missing_as_null(x: Column) -> Column:
    """NaN marks missing samples in files; inside the engine it is null."""
    return F.when(~F.isnan(x), x)


def finite_features(x: Column) -> Column:
    """Null and NaN to 0, +inf to 1, -inf to 0, as the scorers expect."""
    x = x.cast("double")
    return (
        F.when(x.isNull() | F.isnan(x), 0.0).when(x == F.lit(float("inf")), 1.0).when(x == F.lit(float("-inf")), 0.0).otherwise(x)
    )


def safe_ratio(n: Column, d: Column) -> Column:
    return clip(F.try_divide(n, d + EPS), -1.0, 1.0)


def normalised_difference(a: Column, b: Column) -> Column:
    return safe_ratio(a - b, a + b)


def ndvi(nir: Column, red: Column) -> Column:
    return normalised_difference(nir, red)


def ndwi(green: Column, nir: Column) -> Column:
    return normalised_difference(green, nir)


def mndwi(green: Column, swir1: Column) -> Column:
    return normalised_difference(green, swir1)


def ndbi(swir1: Column, nir: Column) -> Column:
    return normalised_difference(swir1, nir)


def nbr(nir: Column, swir2: Column) -> Column:
    return normalised_difference(nir, swir2)


def savi(nir: Column, red: Column, soil: float = 0.5) -> Column:
    return F.try_divide(nir - red, nir + red + (soil + EPS)) * (1 + soil)


def brightness(blue: Column, green: Column, red: Column) -> Column:
    return (blue + green + red) / 3


def spectral_indices(blue, green, red, nir, swir1, swir2) -> dict[str, Column]:
    return {
        "ndvi": ndvi(nir, red),
        "ndwi": ndwi(green, nir),
        "mndwi": mndwi(green, swir1),
        "savi": savi(nir, red),
        "ndbi": ndbi(swir1, nir),
        "brightness": brightness(blue, green, red),
        "nbr": nbr(nir, swir2),
    }


def radar_features(vv: Column, vh: Column) -> dict[str, Column]:
    """Linear intensities, their ratio and the entropy of their shares; a missing second band is 0."""
    vh = F.coalesce(vh, F.lit(0.0))
    p, q = F.try_divide(vv, vv + vh + EPS), F.try_divide(vh, vv + vh + EPS)
    bits = lambda x: x * F.log2(F.greatest(x + EPS, F.lit(EPS)))
    return {
        "vv_linear": F.pow(F.lit(10.0), vv / 10),
        "vh_linear": F.pow(F.lit(10.0), vh / 10),
        "ratio": clip(safe_ratio(vv, vh + EPS), 0.0, 10.0),
        "entropy": -(bits(p) + bits(q)),
    }


def sigma0_db(x: Column, scene_max: Column) -> Column:
    """Backscatter in dB: digital numbers (a scene maximum above 100) are squared and shifted."""
    return F.when(scene_max > 100, 10 * F.log10(F.greatest(x * x, F.lit(EPS))) - 83).otherwise(10 * F.log10(F.greatest(x, F.lit(EPS))))


def landsat_reflectance(x: Column) -> Column:
    return clip(x * LANDSAT_SCALE + LANDSAT_OFFSET, 0.0, 1.0)


def grey(red: Column, green: Column, blue: Column, weights=GREY_FEATURES) -> Column:
    return red * weights[0] + green * weights[1] + blue * weights[2]


def hsv(red: Column, green: Column, blue: Column) -> tuple[Column, Column, Column]:
    """Hue in degrees, saturation and value in [0, 1], after quantising to eight bits."""
    r, g, b = (F.floor(x * 255).cast("double") for x in (red, green, blue))
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    span = top - low
    turn = (
        F.when(span == 0, 0.0)
        .when(top == r, F.try_divide(60 * (g - b), span))
        .when(top == g, 120 + F.try_divide(60 * (b - r), span))
        .otherwise(240 + F.try_divide(60 * (r - g), span))
    )
    return F.when(turn < 0, turn + 360).otherwise(turn), F.when(top == 0, 0.0).otherwise(F.try_divide(span, top)), top / 255


def bare_soil(red: Column, green: Column, blue: Column, nir: Column | None = None) -> Column:
    """Bare ground by colour, by hue, or, with a near-infrared band, by a low vegetation index."""
    ratio = F.try_divide(red, green + EPS)
    by_colour = (red > 100 / 255) & (green > 80 / 255) & (ratio >= 0.8) & (ratio <= 1.5)
    h, s, v = hsv(red, green, blue)
    by_hue = (h >= 20) & (h <= 60) & (s < 0.55) & (v > 0.25) & (v < 0.90)
    found = by_colour | by_hue
    return found if nir is None else found | (ndvi(nir, red) < 0.2)


def spectral_mine(ndvi_: Column, bright: Column) -> Column:
    """Bare and bright: pseudo-label before it is closed and opened."""
    return (ndvi_ < 0.25) & (bright > 0.55)


def mining_vote(bare: Column, entropy: Column, edges: Column, weights=(0.4, 0.3, 0.3), least: float = 0.6) -> Column:
    """Weighted vote of bare ground, texture entropy above 2 and edge density above 0.3."""
    on = lambda c: F.when(c, 1.0).otherwise(0.0)
    # in hundredths, so that the default weights, where any two signals suffice, are exact
    w = [round(x * 100) for x in weights]
    return on(bare) * w[0] + on(entropy > 2) * w[1] + on(edges > 0.3) * w[2] >= round(least * 100)
