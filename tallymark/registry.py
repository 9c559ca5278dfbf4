"""All queries of the engine's own operators, and the SQL each is checked against."""

from .queries import declared, detectors, edges, governance, intake, ledgers, models, population, scopes, sources

_MODULES = (population, detectors, models, governance, intake, declared, ledgers, edges, scopes, sources)
QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLES = {k: v for m in _MODULES for k, v in m.ORACLES.items()}
