"""Small matrices of columns: every cell is an expression, so a factor of each row's or group's matrix stays in the plan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def cholesky(cells: Sequence[Sequence[Column]]) -> list[list[Column]]:
    """The lower factor of a symmetric positive matrix; cells above the diagonal are zero."""
    n = len(cells)
    out: list[list[Column]] = [[F.lit(0.0)] * n for _ in range(n)]
    for i in range(n):
        for j in range(i + 1):
            rest = cells[i][j]
            for k in range(j):
                rest = rest - out[i][k] * out[j][k]
            out[i][j] = F.sqrt(rest) if i == j else rest / out[j][j]
    return out


def outer(a: Sequence[Column], b: Sequence[Column]) -> list[list[Column]]:
    return [[x * y for y in b] for x in a]
