"""Text from numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Units of abbreviated numbers.
UNITS = ((1e9, "b"), (1e6, "m"), (1e3, "k"))


def abbreviated(x: Column) -> Column:
    """Two places and a unit of thousands, millions or billions; na for null."""
    out = F.when(x.isNull() | F.isnan(x), "na")
    for size, unit in UNITS:
        out = out.when(F.abs(x) >= size, F.format_string(f"%.2f{unit}", x / size + 1e-9))
    return out.otherwise(F.format_string("%.2f", x + 1e-9))


def abbreviated_sql(x: str) -> str:
    """The same in SQL."""
    cases = " ".join(f"WHEN abs({x}) >= {size:.0f} THEN printf('%.2f{unit}', {x} / {size:.0f} + 1e-9)" for size, unit in UNITS)
    return f"(CASE WHEN {x} IS NULL THEN 'na' {cases} ELSE printf('%.2f', {x} + 1e-9) END)"
