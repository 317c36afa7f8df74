"""Operators for preparing training text: filters, near copies, scoring, mixing and token files."""
