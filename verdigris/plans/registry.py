"""Every query of the library outside the llm subpackage, with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from verdigris.sources.tables import VIEWS

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, views: bool = True) -> Callable:
    """Register a query; sql may use the views of the sources."""

    def add(f: Callable) -> Callable:
        QUERIES[name] = f
        if sql:
            body = sql.strip()
            if views:
                body = f"WITH {VIEWS.strip()}{', ' + body[5:] if body.upper().startswith('WITH ') else ' ' + body}"
            ORACLES[name] = body
        return f

    return add


from verdigris.plans import basics, explanations, forests, metrics, regions, similarity, splits  # noqa: E402, F401
