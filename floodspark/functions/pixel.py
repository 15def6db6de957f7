"""Pointwise band arithmetic: scaling, decibels, bit fields and spectral indices, all as Columns.

NULL is a masked pixel; a result is NULL where an operand is, and where a divisor is zero.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

c = F.col
div = F.try_divide


def rescale(x: Column, scale: float = 0.0001, offset: float = 0.0) -> Column:
    return x * scale + offset


def power_to_db(x: Column) -> Column:
    """Decibels of a power; NULL for a power that is not positive."""
    return 10 * F.when(x > 0, F.log10(x))


def db_to_power(x: Column) -> Column:
    return F.pow(F.lit(10.0), x / 10)


def extract_bits(x: Column, start: int, end: int | None = None) -> Column:
    """One bit in place (not shifted), or bits ``start`` to ``end`` (exclusive) shifted down."""
    if end is None:
        return x.bitwiseAND(F.lit(1 << start))
    return F.shiftright(x.bitwiseAND(F.lit(sum(1 << i for i in range(start, end)))), start)


def normalized_difference(a: Column, b: Column) -> Column:
    return div(a - b, a + b)


def ndvi() -> Column:
    return normalized_difference(c("nir"), c("red"))


def mndwi() -> Column:
    return normalized_difference(c("green"), c("swir1"))


def mbwi(factor: float = 3) -> Column:
    return factor * c("green") - c("red") - c("nir") - c("swir1") - c("swir2")


def nwi() -> Column:
    dry = c("nir") + c("swir1") + c("swir2")
    return div(c("blue") - dry, c("blue") + dry)


#: Name of an index -> its expression over the harmonised optical or the radar bands.
INDICES: dict[str, Callable[[], Column]] = {
    "ndvi": ndvi,
    "evi": lambda: div(2.5 * (c("nir") - c("red")), c("nir") + 6 * c("red") - 7.5 * c("blue") + 1),
    "mndwi": mndwi,
    "nwi": nwi,
    "gwi": lambda: (c("green") + c("red")) - (c("nir") + c("swir1")),
    "aewinsh": lambda: 4 * (c("green") - c("swir1")) - (0.25 * c("nir") + 2.75 * c("swir2")),
    "aewish": lambda: c("blue") + 2.5 * c("green") - 1.5 * (c("nir") + c("swir1")) - 0.25 * c("swir2"),
    "lswi": lambda: normalized_difference(c("nir"), c("swir1")),
    "wri": lambda: div(c("green") + c("red"), c("nir") + c("swir1")),
    "mbwi": mbwi,
    "mwi": lambda: 1 - (ndvi() - mndwi()),
    "rvi": lambda: div(4 * c("vh"), c("vv") + c("vh")),
    "vv_vh_ratio": lambda: div(c("vv"), c("vh")),
    "vv_vh_abs_sum": lambda: F.abs(c("vv") + c("vh")),
    "ndpi": lambda: normalized_difference(c("vv"), c("vh")),
    "nvvi": lambda: div(c("vv"), c("vv") + c("vh")),
    "nvhi": lambda: div(c("vh"), c("vv") + c("vh")),
}
OPTICAL = ("ndvi", "evi", "mndwi", "nwi", "gwi", "aewinsh", "aewish", "lswi", "wri", "mbwi", "mwi")
RADAR = ("rvi", "vv_vh_ratio", "vv_vh_abs_sum", "ndpi", "nvvi", "nvhi")


def add_indices(px: DataFrame, names: list[str] | tuple[str, ...]) -> DataFrame:
    """``px`` with one more band for each named index; an unknown name raises KeyError."""
    return px.withColumns({name: INDICES[name]() for name in names})
