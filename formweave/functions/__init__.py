"""Scalar functions, Column to Column, inside whole-stage code generation but for ``fuzzy``."""
