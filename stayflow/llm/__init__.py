"""Operators that prepare text for training: dedup, sharding, mixing, decontamination, filters and token files."""
