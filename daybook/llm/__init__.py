"""Operators of a training-data pipeline: quality, language, dedup, secrets, mixing, sharding, decontamination."""
