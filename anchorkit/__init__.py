"""anchorkit: cohort and event-window analytics as Spark DataFrame jobs."""
