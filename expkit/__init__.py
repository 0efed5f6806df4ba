"""expkit — retail A/B-experiment analytics on Spark DataFrames.

Layout:
  config          run parameters and fixed domain constants
  functions/      column expressions (casts, dates, normal/chi-square tails)
  sources/        table access, test-data adapters, sinks, coverage checks
  operators/      builders, exposure/assignment, metric aggregation, statistics,
                  scorecard and reconciliation operators
  plans/          metric/test registries, end-to-end runs, named query catalog
  streaming/      incremental exposure monitoring with Structured Streaming
"""

__version__ = "0.1.0"
