"""Scalar functions as Column expressions, and the query planner."""
