"""Similarity analytics over units, documents and vectors, written for Spark."""
