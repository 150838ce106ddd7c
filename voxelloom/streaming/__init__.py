"""Incremental forms of the job log, the search and the statistics."""
