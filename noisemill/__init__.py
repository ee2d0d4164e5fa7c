"""Private synthetic tables, their marginals and their evaluation, as Spark jobs."""
