"""Streamlake: clickstream, change-data mirroring and governed access as plain Spark jobs."""
