"""Queries and jobs put together from operators."""
