"""Retrieval analytics over large text collections, on PySpark."""
