"""helixlake: structural-variant analytics and corpus preparation as Spark jobs."""
