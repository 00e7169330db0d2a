"""Scalar functions as column expressions; all of them stay inside generated code."""
