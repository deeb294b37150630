"""Registered queries (Spark) and their DuckDB oracle SQL.

Importing this package registers every query module.
"""

from tandem.plans import q_density, q_files, q_paired, q_pairwise, q_runs, q_sampling, q_scores, q_subsample, q_vocab  # noqa: F401
from tandem.plans.registry import ORACLE, QUERIES  # noqa: F401
