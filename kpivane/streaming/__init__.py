"""Incremental processing of the signal table."""
