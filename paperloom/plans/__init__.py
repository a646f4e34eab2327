"""Whole jobs: extraction, sampling, query generation and evaluation, and their command line."""
