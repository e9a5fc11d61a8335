"""Multi-cohort longitudinal association analytics as Spark jobs."""
