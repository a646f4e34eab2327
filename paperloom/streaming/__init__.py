"""Incremental runs over arriving files: an addition to the batch jobs, not a change of them."""
