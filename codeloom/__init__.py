"""Code-graph and text analytics as PySpark DataFrame pipelines."""
