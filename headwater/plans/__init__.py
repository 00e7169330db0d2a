"""Compositions of operators: the graph build, the analyses and the reports."""
