"""Versioned key-value data on Spark: upserts, levels, flushes, merges and their codecs."""
