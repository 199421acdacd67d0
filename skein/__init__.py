"""Skein: document retrieval and event analytics as Spark DataFrame operators."""
