"""A Spark library for job-posting funnels and training-data pipelines."""
