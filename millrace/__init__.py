"""Millrace: labelled-corpus analytics and retrieval-style workloads on PySpark."""
