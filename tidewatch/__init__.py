"""Panel early-warning analytics as PySpark DataFrame jobs."""
