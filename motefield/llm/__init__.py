"""Operators of a training-data pipeline: packing, cleaning, search, archives, tokens and quality."""
