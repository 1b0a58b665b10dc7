"""Operators for preparing training text: quality, language, extraction, dedup, mixing, output."""
