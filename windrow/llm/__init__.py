"""Operators for preparing training text: filters, scores, duplicates, mixing and encoding."""
