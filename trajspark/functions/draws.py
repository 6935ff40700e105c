"""Repeatable draws: keyed hashes by plain arithmetic, which any SQL engine can repeat."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Draws lie in [0, RANGE).
RANGE = 2147483587
FACTORS = (1640531527, 1103515245, 805459861, 1779033703, 668265263, 374761393)
FIRST, SECOND, PART = 2147483647, 2147483629, 1 << 20


def draw(*parts: Column) -> Column:
    """A number in [0, RANGE) from up to six whole numbers: their parts modulo 2**20 are weighed and summed
    up, and the sum is squared twice, each time modulo another prime."""
    x = F.pmod(sum((F.pmod(p.cast("long"), F.lit(PART)) * f for p, f in zip(parts, FACTORS, strict=False)), F.lit(7).cast("long")), F.lit(FIRST))
    y = F.pmod(x * x + 12345, F.lit(SECOND))
    return F.pmod(y * y + 54321, F.lit(RANGE))


def draw_sql(*parts: str) -> str:
    """The same as SQL over parts that are not negative."""
    x = "((7 + " + " + ".join(f"(cast({p} as bigint) % {PART}) * {f}" for p, f in zip(parts, FACTORS, strict=False)) + f") % {FIRST})"
    y = f"(({x} * {x} + 12345) % {SECOND})"
    return f"(({y} * {y} + 54321) % {RANGE})"
