"""Closed-form tails of Student's t (so of F with one degree on top), as columns, NumPy and SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def _series(df: int) -> list[float]:
    """Coefficients of the finite cosine series for ``df`` degrees of freedom."""
    if df % 2 == 0:
        out = [1.0] if df >= 2 else []
        for k in range(1, df // 2):
            out.append(out[-1] * (2 * k - 1) / (2 * k))
    else:
        out = [1.0] if df >= 3 else []
        for k in range(1, (df - 1) // 2):
            out.append(out[-1] * (2 * k) / (2 * k + 1))
    return out


def _horner(terms: list[float], x):
    acc = None
    for c in reversed(terms):
        acc = c if acc is None else acc * x + c
    return 0.0 if acc is None else acc


def f_tail_numpy(f: np.ndarray, df: int) -> np.ndarray:
    """P(F(1, df) > f)."""
    r = np.sqrt(np.maximum(f, 0) / df)
    cos2, sin = 1 / (1 + r * r), r / np.sqrt(1 + r * r)
    s = _horner(_series(df), cos2)
    p = 1 - sin * s if df % 2 == 0 else 1 - 2 / np.pi * (np.arctan(r) + sin * np.sqrt(cos2) * s)
    return np.clip(p, 0.0, 1.0)


def f_tail(f: Column, df: int) -> Column:
    """The same as an expression inside generated code."""
    r = F.sqrt(F.greatest(f, F.lit(0.0)) / df)
    cos2, sin = 1 / (1 + r * r), r / F.sqrt(1 + r * r)
    acc: Column = F.lit(0.0)
    for c in reversed(_series(df)):
        acc = acc * cos2 + F.lit(c)
    p = 1 - sin * acc if df % 2 == 0 else 1 - F.lit(2 / np.pi) * (F.atan(r) + sin * F.sqrt(cos2) * acc)
    return F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0))


def f_tail_sql(f: str, df: int) -> str:
    """The same as SQL text."""
    r = f"sqrt(greatest({f}, 0) / {df}e0)"
    cos2, sin = f"(1 / (1 + {r} * {r}))", f"({r} / sqrt(1 + {r} * {r}))"
    acc = "0e0"
    for c in reversed(_series(df)):
        acc = f"({acc} * c2 + {c!r}::DOUBLE)"
    body = f"1 - {sin} * S" if df % 2 == 0 else f"1 - {2 / np.pi!r}::DOUBLE * (atan({r}) + {sin} * sqrt({cos2}) * S)"
    return f"least(greatest({body.replace('S', acc.replace('c2', cos2))}, 0), 1)"
