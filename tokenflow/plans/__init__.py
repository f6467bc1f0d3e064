"""Query plans: the registered queries (Spark side + DuckDB oracle SQL) and
the end-to-end pipelines that compose operators."""
