"""Corpus and learning analytics as DataFrame-in, DataFrame-out operators on PySpark."""
