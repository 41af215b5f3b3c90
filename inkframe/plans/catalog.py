"""All queries of the reference's operators."""

from inkframe.plans import choice_queries, file_queries, geometry_queries, job_queries, more_queries, ranker_queries, registry, table_queries, trial_queries  # noqa: F401

QUERIES, SQL = registry.QUERIES, registry.SQL
