"""Operators for preparing training text: duplicates, quality, language, secrets, scoring and packing."""
