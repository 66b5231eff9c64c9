"""Operators for training-data corpora: thirteen numbered operators, their queries and SQL."""
