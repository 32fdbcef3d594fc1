"""Spark-first llm."""
