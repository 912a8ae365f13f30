"""Readers, typed reads, configuration frames and result tables."""
