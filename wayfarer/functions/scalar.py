"""Column functions that every operator shares. All stay inside the JVM.

A value that NumPy would give as NaN or infinite is null here, from the expression on that produces it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

DAY = 86_400


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite(c: Column) -> Column:
    """``c``, or null where it is NaN or infinite."""
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)


def ratio(a: Column | str, b: Column | str) -> Column:
    """``a / b``, null where ``b`` is 0."""
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


def distance(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Euclidean distance."""
    return F.sqrt(F.pow(x1 - x0, F.lit(2.0)) + F.pow(y1 - y0, F.lit(2.0)))


def micros(ts: Column | str) -> Column:
    """Microseconds since 1970 of a timestamp without time zone."""
    return F.unix_micros(col(ts).cast("timestamp"))


def seconds_between(t0: Column | str, t1: Column | str, unwrapped: bool = False) -> Column:
    """Whole seconds from ``t0`` to ``t1``, floored; days are left out unless ``unwrapped``."""
    s = F.floor((micros(t1) - micros(t0)) / 1e6)
    return s if unwrapped else F.pmod(s, F.lit(DAY).cast("long"))


def second_of_day(ts: Column | str) -> Column:
    """Seconds since midnight, with fractions."""
    return F.pmod(micros(ts), F.lit(DAY * 1_000_000).cast("long")) / 1e6


def time_bin(ts: Column | str, minutes: int) -> Column:
    """The nearest multiple of ``minutes``, ties to the even multiple, as a timestamp without time zone."""
    width = minutes * 60_000_000
    return F.timestamp_micros((F.rint(micros(ts) / float(width)) * width).cast("long")).cast("timestamp_ntz")


def track(*keys: str) -> WindowSpec:
    """A device's signals in time order; ties go by id, then place."""
    return Window.partitionBy(*(keys or ("mac_address",))).orderBy("date_time", "event_id")


def is_shop(store: Column | str) -> Column:
    """Shops begin with B."""
    return F.substring(col(store), 1, 1) == "B"


def has_shop(store: Column | str) -> Column:
    """The looser predicate: a B anywhere in the id."""
    return F.contains(col(store), F.lit("B"))


def label_of(probability: Column | str) -> Column:
    """1 above 0.95, 0 below 0.05, else 0.5; both bounds are strict."""
    p = col(probability)
    return F.when(p > 0.95, 1.0).when(p < 0.05, 0.0).otherwise(0.5)


def bayes_bool(result: Column | str, likelihood: Column | str, prior: Column | str) -> Column:
    """Unnormalised posterior: the likelihood of a boolean result, from the pair (if false, if true), times the prior."""
    return F.element_at(col(likelihood), col(result).cast("int") + 1) * col(prior)


def oui_prefix(mac: Column | str) -> Column:
    """The first six hex digits of a MAC in upper case."""
    return F.substring(F.upper(F.regexp_replace(col(mac), ":", "")), 1, 6)


def mac_bits(mac: Column | str, compat: bool = True) -> Column:
    """A MAC as a binary string; ``compat`` puts two zeros before the number's own digits, else 48 digits are kept."""
    bits = F.conv(F.regexp_replace(col(mac), ":", ""), 16, 2)
    return F.concat(F.lit("00"), bits) if compat else F.lpad(bits, 48, "0")


def reverse_mac(mac: Column | str) -> Column:
    """A MAC with the bits of each octet reversed."""
    bits = mac_bits(mac, compat=False)
    octet = lambda i: F.lpad(F.lower(F.conv(F.reverse(F.substring(bits, 8 * i + 1, 8)), 2, 16)), 2, "0")
    return F.concat_ws(":", *(octet(i) for i in range(6)))


def centre_angle(x: Column | str, y: Column | str, x0: float = 175.0, y0: float = 75.0) -> Column:
    """Angle about the mall's centre, above 0 and up to a full turn."""
    a = F.atan2(col(y) - y0, col(x) - x0)
    return F.when(a <= 0, a + 2 * math.pi).otherwise(a)


def angle_direction(a1: Column | str, a2: Column | str) -> Column:
    """-1 for less than a third of a turn on, +1 for more than two thirds, else 0; null if the angles are equal."""
    turn = 2 * math.pi
    d = col(a2) - col(a1)
    d = d - F.floor(d / turn) * turn
    return F.when(col(a1) == col(a2), None).when(d < turn / 3, -1).when(d > 2 * turn / 3, 1).otherwise(0)


def gaussian(x: Column | str, mu: float, sigma: float, compat: bool = True) -> Column:
    """A Gaussian likelihood; ``compat`` normalises by the root of 2 pi sigma, as older scripts do."""
    norm = math.sqrt(2 * math.pi * sigma) if compat else sigma * math.sqrt(2 * math.pi)
    return F.exp(-F.pow(col(x) - mu, F.lit(2.0)) / (2 * sigma * sigma)) / norm
