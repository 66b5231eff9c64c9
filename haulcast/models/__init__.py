"""Regressors per truck type on MLlib."""
