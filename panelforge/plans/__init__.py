"""Whole research pipelines composed from the operators."""
