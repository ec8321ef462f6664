"""Operators of a training-data pipeline: scoring, decontamination, extraction, deduplication, formatting, filtering, tokenizing."""
