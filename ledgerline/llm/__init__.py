"""Operators of a training-data pipeline: tokens, deduplication, scoring, extraction, mixing, packing.

Each module holds one operator; ``queries.py`` registers one query per operator.
Nothing else in the library imports this subpackage.
"""
