"""Lexical retrieval and corpus preparation on Spark."""
