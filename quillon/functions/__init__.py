"""Scalar text functions, as plain Python and as Spark columns."""
