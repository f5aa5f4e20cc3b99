"""Whole plans made of operators, and the queries that run them."""
