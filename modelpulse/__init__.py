"""Model monitoring on Spark: vitals, grading, dependency graph, batch and stream."""
