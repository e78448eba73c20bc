"""Listing intelligence on Spark: parsing, quality gates, identity, lifecycle, profiling and pricing."""
