"""Event journals, command gates and read models as Spark DataFrame jobs."""
