"""Hyper-parameters: random draws and grids, on the driver; columns by name."""

from __future__ import annotations

import itertools
import random
from typing import Any


def drawn(spec: dict[str, Any], seed: int) -> dict[str, Any]:
    """One value for each parameter: (int, lo, hi) a whole number, both ends included; (float, lo, hi) a real one; a list
    of such triples a list of reals; another list one of its values; anything else is taken as it is."""
    r = random.Random(seed)

    def one(x: Any) -> Any:
        if isinstance(x, tuple):
            kind, lo, hi = x
            if kind not in (int, float):
                raise ValueError(f"neither int nor float: {kind}")
            return r.randint(lo, hi) if kind is int else lo + (hi - lo) * r.random()
        if isinstance(x, list) and x:
            return [lo + (hi - lo) * r.random() for _, lo, hi in x] if isinstance(x[0], tuple) else r.choice(x)
        return x

    return {k: one(v) for k, v in spec.items()}


def grid(spec: dict[str, list]) -> list[dict[str, Any]]:
    """Every combination of the values, the last parameter fastest."""
    return [dict(zip(spec, values)) for values in itertools.product(*spec.values())]


def labels_by_name(columns: list[str], holds: str = "_", lacks: str = "_sc") -> list[str]:
    """The columns whose name holds the one text and lacks the other, in order."""
    return [c for c in columns if holds in c and lacks not in c]
