"""Equi-joins against a side that is usually small, without betting on it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows and bytes up to which the small side may be broadcast.
BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 64 << 20
#: Copies of the small side when it is too large to broadcast, so that a hot key of the big side is split.
SALTS = 16


def fits(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Whether ``df`` has at most so many rows and bytes. Strings count by their length, arrays and maps by 32 bytes an
    element, everything else by 16; no more than ``rows`` + 1 rows are looked at."""
    cost = F.lit(0).cast("bigint")
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        cost = cost + F.coalesce(F.octet_length(c) if kind in ("string", "binary") else F.size(c) * 32 if kind.startswith(("array", "map")) else F.lit(16), F.lit(0))
    n, total = df.limit(rows + 1).select(cost.alias("_cost")).agg(F.count("*"), F.sum("_cost")).first()
    return n <= rows and (total or 0) <= size


def join_small(big: DataFrame, small: DataFrame, on: list[str], how: str = "inner", limit: int = BROADCAST_ROWS, unique: bool = False) -> DataFrame:
    """Join ``big`` to ``small``: by broadcast once a look at ``small`` has shown that it fits, else shuffled.

    ``how`` is inner, left, left_semi or left_anti. In the shuffled form every row of ``big`` takes one of ``SALTS``
    salts and ``small`` is repeated for each, so that a key holding a third of ``big`` is spread; not so where keys are
    ``unique`` in ``big``. The look is a job of its own over ``small``; callers hand in tables that are written, or
    cheap to make again.
    """
    if fits(small, limit):
        return big.join(F.broadcast(small), on, how)
    if unique:
        return big.join(small, on, how)
    # from the row's own values, so that a task that runs again makes the same choice
    plain = [c for c, kind in big.dtypes if not kind.startswith(("map", "array", "struct"))]
    numbers = [c for c, kind in big.dtypes if kind in ("int", "bigint") and c not in on]
    salted = big.withColumn("_salt", F.pmod(F.xxhash64(*(numbers or plain)), F.lit(SALTS)))
    copies = small.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))
    return salted.join(copies, [*on, "_salt"], how).drop("_salt")
