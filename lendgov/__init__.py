"""lendgov: credit-decision analytics and governance as Spark jobs.

Layout:
  sources/    readers for the input tables, derived views, file sources and sinks
  functions/  column-level building blocks (features, quantiles, text, hashing)
  operators/  DataFrame operators (fairness, monitoring, consent, audit, ...)
  plans/      the named query registry and its DuckDB oracle SQL
  streaming/  Structured Streaming jobs
"""

__all__ = ["session"]
