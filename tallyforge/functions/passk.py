"""The unbiased pass@k estimate of one task as a Column."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def pass_at_k(n: Column | str, c: Column | str, k: int) -> Column:
    """Chance that at least one of ``k`` draws out of ``n`` attempts is one of the ``c`` passes.

    ``1 - C(n-c, k) / C(n, k)`` as a product of ``k`` factors, so the cost depends on
    ``k`` only and never on the number of attempts of the task.
    """
    n = (F.col(n) if isinstance(n, str) else n).cast("double")
    c = (F.col(c) if isinstance(c, str) else c).cast("double")
    miss = reduce(lambda a, b: a * b, [(n - c - F.lit(float(j))) / (n - F.lit(float(j))) for j in range(k)])
    return (
        F.when(n < F.lit(float(k)), F.lit(None).cast("double"))
        .when(c == 0, F.lit(0.0))
        .when(n - c < F.lit(float(k)), F.lit(1.0))
        .otherwise(F.lit(1.0) - miss)
    )
