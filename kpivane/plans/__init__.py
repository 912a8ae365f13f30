"""Ready-made stars and queries over the TPC-H-like tables, and the end-to-end run."""
