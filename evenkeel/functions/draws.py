"""Random draws that depend on a key and a salt only.

``rand(seed)`` depends on how the rows are partitioned, so a retried task could
draw other numbers. These draws come from md5 and repeat anywhere.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

STEPS = float(2**52)


def _text(keys: Column | str | tuple | list, salt) -> Column:
    if isinstance(keys, (Column, str)):
        keys = [keys]
    parts = [F.col(k) if isinstance(k, str) else k for k in keys]
    return F.concat_ws(":", F.lit(str(salt)), *[p.cast("string") for p in parts])


def uniform(keys, salt=0) -> Column:
    """A draw in [0, 1) for each key: the first 52 bits of md5('salt:key')."""
    digits = F.substring(F.md5(_text(keys, salt)), 1, 13)
    return F.conv(digits, 16, 10).cast("bigint") / F.lit(STEPS)


def normal(keys, salt=0) -> Column:
    """A standard normal draw (Box-Muller on two uniform draws)."""
    radius = F.sqrt(F.lit(-2.0) * F.log(F.lit(1.0) - uniform(keys, f"{salt}r")))
    return radius * F.cos(F.lit(2.0 * math.pi) * uniform(keys, f"{salt}a"))
