"""Operators of a training-data pipeline: cleaning, deduplication, mixing and scoring of documents."""
