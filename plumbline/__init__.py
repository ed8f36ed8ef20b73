"""Plumbline: document-knowledge processing and retrieval analytics on Spark DataFrames."""
