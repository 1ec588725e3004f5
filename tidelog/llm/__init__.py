"""Operators for preparing text corpora: tokenizing, filtering, de-duplicating, scoring, archiving."""
