"""Operators for large training corpora: each takes a DataFrame and returns one."""
