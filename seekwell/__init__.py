"""Spark jobs for indexing, searching and curating large document collections."""
