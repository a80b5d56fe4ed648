"""All queries of the core, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from glossmark.plans import evaluation, problems

QUERIES = {**evaluation.QUERIES, **problems.QUERIES}
SQL = {**evaluation.SQL, **problems.SQL}
