"""Scalar functions: text analysis and scoring, as Columns and as plain Python."""
