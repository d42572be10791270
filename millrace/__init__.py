"""Millrace: collections of job postings as Spark DataFrames, from raw payloads to ranked answers."""
