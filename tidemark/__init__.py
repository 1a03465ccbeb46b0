"""Tidemark: point-in-time news and market analytics as Spark DataFrame transforms."""
