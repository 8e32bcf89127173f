"""Operators for the preparation of training text, each over a `documents` table."""
