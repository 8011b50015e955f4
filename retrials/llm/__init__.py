"""Operators for training text: rules, duplicates, extraction, scoring, mixing, formatting."""
