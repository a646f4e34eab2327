"""Relational operators: page extraction, curation, sampling, retrieval, evaluation and agents."""
