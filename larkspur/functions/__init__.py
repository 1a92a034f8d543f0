"""Scalar semantics: as Spark columns, and on plain values."""
