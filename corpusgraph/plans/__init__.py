"""Queries and pipelines built of the operators."""
