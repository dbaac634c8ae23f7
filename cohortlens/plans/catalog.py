"""The registered queries of the verification library and their DuckDB twins."""

from __future__ import annotations

from . import checks, core, files, more, parts, texts  # noqa: F401  the others add to core's registry

QUERIES: dict = dict(core.QUERIES)
ORACLES: dict = dict(core.ORACLES)
