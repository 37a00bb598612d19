"""The operators bound to the test tables, with the SQL that checks them."""

from . import q_effects, q_functions, q_index, q_jobs, q_reads, q_stats, q_tables  # noqa: F401
from .registry import QUERIES, check_sql, run  # noqa: F401
