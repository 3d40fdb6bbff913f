"""Back-off multipliers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fibonacci_numbers(count: int) -> list[int]:
    """The first ``count`` numbers of 0, 1, 1, 2, 3, 5, ..."""
    numbers = [0, 1]
    while len(numbers) < count:
        numbers.append(numbers[-2] + numbers[-1])
    return numbers[:count]


def fibonacci_multiplier(attempts: Column, max_attempts: int) -> Column:
    """Multiplier for ``attempts`` in [0, max_attempts); NULL outside."""
    table = F.array(*[F.lit(n).cast("bigint") for n in fibonacci_numbers(max_attempts)])
    return F.when(
        (attempts >= 0) & (attempts < max_attempts),
        F.get(table, attempts.cast("int")),
    )
