"""Queries and SQL of this subpackage, for the repository's entry point."""

from . import ann, htmltext, media, mixing, neardup, packing, secrets, tokens, toxicity, urlrank

_MODULES = (media, tokens, toxicity, neardup, secrets, urlrank, mixing, packing, htmltext, ann)
QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLES = {k: v for m in _MODULES for k, v in m.ORACLES.items()}
