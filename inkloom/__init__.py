"""Inkloom: analytics over evidence-centred text corpora, on Spark."""
