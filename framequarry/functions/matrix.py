"""3 x 3 matrices as ARRAY<DOUBLE> of nine, row by row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SINGULAR = 1e-12


def lit9(values: list[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def determinant(m: Column) -> Column:
    return m[0] * (m[4] * m[8] - m[5] * m[7]) - m[1] * (m[3] * m[8] - m[5] * m[6]) + m[2] * (m[3] * m[7] - m[4] * m[6])


def inverse(m: Column) -> Column:
    """Cofactors over the determinant; null if the matrix is singular."""
    det = determinant(m)
    s = F.lit(1.0) / F.nullif(det, F.lit(0.0))

    def minor(a: int, b: int, c: int, d: int) -> Column:
        return (m[a] * m[b] - m[c] * m[d]) * s

    cells = [minor(4, 8, 5, 7), minor(2, 7, 1, 8), minor(1, 5, 2, 4), minor(5, 6, 3, 8), minor(0, 8, 2, 6), minor(2, 3, 0, 5), minor(3, 7, 4, 6), minor(1, 6, 0, 7), minor(0, 4, 1, 3)]
    return F.when(F.abs(det) >= SINGULAR, F.array(*cells))


def product(a: Column, b: Column) -> Column:
    return F.array(*[a[3 * r] * b[c] + a[3 * r + 1] * b[3 + c] + a[3 * r + 2] * b[6 + c] for r in range(3) for c in range(3)])
