"""Quillstone: analytics and retrieval over numbered, hierarchical documents, on Spark DataFrames."""
