"""Scalar expressions, all of them built-in columns that stay inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: random numbers are multiples of 1 / LATTICE.
LATTICE = 2147483647
#: Fixed values of the weight rescale for affinity graphs.
AFFINITY_FACTOR, AFFINITY_LEAST = 100000.0, 1.0


def rng(*parts: Column | int | str) -> Column:
    """A number in [0, 1) that depends on parts alone: the same in every partition, on every retry, in every engine."""
    text = F.concat_ws("|", *[(p if isinstance(p, Column) else F.lit(p)).cast("string") for p in parts])
    draw = F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")
    return (draw % LATTICE) / F.lit(float(LATTICE))


def affinity_rescale(w: Column) -> Column:
    return F.greatest(w * AFFINITY_FACTOR, F.lit(AFFINITY_LEAST))


def weight_bucket(w: Column) -> Column:
    """The least b with w <= 2**b, exact also at powers of two, where the logarithm's rounding is not."""
    b = F.ceil(F.log2(w)).cast("int")
    return F.when(F.pow(F.lit(2.0), b - 1) >= w, b - 1).when(F.pow(F.lit(2.0), b) < w, b + 1).otherwise(b)


def walk_count(eps: float) -> int:
    """How many walks a walk query takes: 4 / eps, truncated after both divisions."""
    return int(1.0 / eps / 0.25)


def push_samples(eps: float, length: int) -> int:
    """How many samples a sampled push takes."""
    return int(0.1 * length / eps * 4.0)


def walk_count_of(eps: Column) -> Column:
    """walk_count of a column."""
    return (F.lit(1.0) / eps / F.lit(0.25)).cast("long")


def push_samples_of(eps: Column, length: int) -> Column:
    """push_samples of a column."""
    return (F.lit(0.1 * length) / eps * F.lit(4.0)).cast("long")
