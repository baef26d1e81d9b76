"""Results against results: floats within 1e-9, absolute and relative; all else exactly; order only where it counts."""

from __future__ import annotations

import math
from collections.abc import Sequence

EPSILON = 1e-9


def same_cell(a: object, b: object) -> bool:
    if a is None or b is None:
        return a is b
    if isinstance(a, float) and isinstance(b, float):
        if math.isnan(a) or math.isnan(b):
            return math.isnan(a) and math.isnan(b)
        return a == b or abs(a - b) <= EPSILON + EPSILON * max(abs(a), abs(b)) < math.inf
    return type(a) is type(b) and a == b


def _order(row: Sequence) -> tuple:
    def key(x: object) -> tuple:
        if x is None:
            return (0,)
        if isinstance(x, float):
            return (2,) if math.isnan(x) else (1, float(f"{x:.6g}"))
        return (1, x)

    return tuple(map(key, row))


def differences(a: Sequence[Sequence], b: Sequence[Sequence], ordered: bool = False) -> list[str]:
    """What differs; empty if nothing does."""
    if len(a) != len(b):
        return [f"{len(a)} rows against {len(b)}"]
    if not ordered:
        a, b = sorted(a, key=_order), sorted(b, key=_order)
    out = []
    for i, (x, y) in enumerate(zip(a, b, strict=True)):
        if len(x) != len(y) or not all(map(same_cell, x, y)):
            out.append(f"row {i}: {tuple(x)} against {tuple(y)}")
    return out
