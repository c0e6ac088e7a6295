"""Number formatting as column expressions, and axis helpers for the driver."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

IEC = ["", "Ki", "Mi", "Gi", "Ti", "Pi", "Ei", "Zi", "Yi"]
# Exponent of ten and unit prefix, largest first.
SI = [(24, "Y"), (21, "Z"), (18, "E"), (15, "P"), (12, "T"), (9, "G"), (6, "M"), (3, "K"), (0, ""), (-2, "c"), (-3, "m"), (-6, "u"), (-9, "n"), (-12, "p"), (-15, "f")]
# Suffixes of the unit wrappers.
UNITS = {"flops": "flop/s", "tflop": "s/flop", "bandwidth": "B/s", "tbyte": "s/B", "accesses": "acc/s", "flops_per_joule": "flop/J", "joules_per_flop": "J/flop", "joules_per_byte": "J/B", "bytes_per_joule": "B/J", "watts": "W"}


def digits(c: Column) -> Column:
    """Exponent of ten of a non-zero number."""
    return F.floor(F.log10(F.abs(c.cast("double"))))


def signif(c: Column, k: int) -> Column:
    """Rounded to k significant digits."""
    x = c.cast("double")
    p = F.pow(F.lit(10.0), (k - 1 - digits(c)).cast("double"))
    return F.when(x == 0, F.lit(0.0)).otherwise(F.round(x * p) / p)


def sigfig_label(c: Column, k: int) -> Column:
    """k significant digits as plain text; null is ``NA`` and zero ``0.`` with k - 1 zeros."""
    x = c.cast("double")
    label = F.lit(None).cast("string")
    for places in range(0, 16):  # format_string needs a constant pattern
        label = F.when(F.greatest(k - 1 - digits(x), F.lit(0)) == places, F.format_string(f"%.{places}f", signif(x, k))).otherwise(label)
    return F.when(x.isNull(), F.lit("NA")).when(x == 0, F.lit("0." + "0" * (k - 1))).otherwise(label)


def _scaled(x: Column, steps: list[tuple[float, str]], suffix: str, places: int) -> Column:
    """``x`` over the first step that it reaches and the step's name; unscaled below all of them, and so are negative numbers."""
    number = lambda v: F.bround(v, 0).cast("decimal(38,0)").cast("string") if not places else F.bround(v, places).cast("string")
    out = F.concat(number(x), F.lit(f" {suffix}"))
    for at, name in reversed(steps):
        out = F.when(x >= at, F.concat(number(x / at), F.lit(f" {name}{suffix}"))).otherwise(out)
    return out


def iec(c: Column, suffix: str = "", places: int = 0) -> Column:
    """Binary units, rounded half to even: 1536 becomes ``2 Ki``."""
    return _scaled(c.cast("double"), [(1024.0**i, IEC[i]) for i in range(len(IEC) - 1, 0, -1)], suffix, places)


def si(c: Column, suffix: str = "", places: int = 0) -> Column:
    """Decimal units, rounded half to even: 1499 becomes ``1 K``."""
    return _scaled(c.cast("double"), [(float(f"1e{e}"), name) for e, name in SI], suffix, places)


def si_unit(c: Column, kind: str) -> Column:
    return si(c, UNITS[kind])


def times_label(c: Column) -> Column:
    """``1.25x``."""
    return F.format_string("%.2fx", c.cast("double"))


def step_size(low: float, high: float, intervals: int = 10) -> float:
    """Of 0.1, 0.2, 0.25, 0.5 and 1 times the power of ten, the step whose number of intervals is nearest to the wanted one."""
    width = high - low
    if width <= 0:
        return 1.0
    unit = 10.0 ** math.floor(math.log10(width))
    return min((s * unit for s in (0.1, 0.2, 0.25, 0.5, 1.0)), key=lambda s: abs(width / s - intervals))


def ticks(low: float, high: float, step: float | None = None) -> list[float]:
    s = step or step_size(low, high)
    first, last = math.floor(low / s + 1e-9), math.ceil(high / s - 1e-9)
    return [i * s for i in range(first, last + 1)]


def ticks_log(low: float, high: float, base: int = 2) -> list[float]:
    return [float(base) ** e for e in range(math.floor(math.log(low, base) + 1e-9), math.ceil(math.log(high, base) - 1e-9) + 1)]


def labels_log2(values: list[float], plain: int = 8) -> list[str]:
    """Powers of two: plain up to 2^``plain``-ish sizes, else ``2^k``; below one ``1/2^k``."""
    out = []
    for v in values:
        k = round(math.log2(v))
        out.append((f"2^{k}" if k > plain else f"{2**k}") if k >= 0 else (f"1/2^{-k}" if -k > plain else f"1/{2 ** -k}"))
    return out


def reverse_log(c: Column, base: float = math.e) -> Column:
    return -F.log(float(base), c.cast("double"))
