"""Registered queries of the evidence operators and their DuckDB equivalents."""

from . import acceptance, assemblies, finals, greedy, matches, models, oracle, queries, rasters, records, rotations, verdicts

QUERIES = queries.QUERIES | records.QUERIES | verdicts.QUERIES | models.QUERIES | rasters.QUERIES | acceptance.QUERIES | matches.QUERIES | rotations.QUERIES | assemblies.QUERIES | finals.QUERIES
ORACLE = oracle.ORACLE | greedy.ORACLE | records.ORACLE | verdicts.ORACLE | models.ORACLE | rasters.ORACLE | acceptance.ORACLE | matches.ORACLE | rotations.ORACLE | assemblies.ORACLE | finals.ORACLE

__all__ = ["ORACLE", "QUERIES"]
