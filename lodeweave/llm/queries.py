"""All queries of the package and their SQL checks."""

from lodeweave.llm import components, containers, cross_split, leakage, log_sketch, reading_level, term_frequency, top_candidates

_MODULES = [top_candidates, term_frequency, components, log_sketch, cross_split, leakage, reading_level, containers]
QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLE = {name: sql for m in _MODULES for name, sql in m.ORACLE.items()}
