"""Spark library for analysing crawled job postings: extract, conform, keep history, query, export."""
