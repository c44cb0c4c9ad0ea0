"""A memory, retrieval and text-analytics engine on PySpark."""
