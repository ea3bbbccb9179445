"""Query plans: log queries, trends, statistics, cost, diagnostics, sizing."""
