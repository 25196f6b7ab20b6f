"""Operators for training-data pipelines: scoring, deduplication, decontamination, packing, archives.

Nothing outside this folder imports it, so it can be removed as a whole.
"""
