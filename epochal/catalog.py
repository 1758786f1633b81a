"""Every registered query of the panel engine with its SQL counterpart."""

from __future__ import annotations

from epochal import registry
from epochal.plans import clusters, evidence, groups, joins, kernels, models, orbits, robust, rollups, screening, shapes, spectra, surfaces, windows  # noqa: F401  (they register their queries)

FLAGSHIP = "occupancy_7d"


def queries() -> dict[str, registry.Query]:
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registry.SQL)
