"""Structured Streaming forms of the daily rollup and the outcome resolution."""
