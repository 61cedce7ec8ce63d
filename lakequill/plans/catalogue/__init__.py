"""All named queries, by family."""

from lakequill.plans.catalogue import basics, dates_json, functions, grouping, joins, sqltext, subqueries, windows  # noqa: F401
