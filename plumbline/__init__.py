"""Table reconciliation and profiling on Spark."""
