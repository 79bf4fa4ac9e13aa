"""Block-allocation analytics over video tables, as Spark jobs."""
