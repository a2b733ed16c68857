"""Schema-drift experiments on tabular data and corpus operators, as Spark jobs."""
