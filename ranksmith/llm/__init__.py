"""Operators for large-scale training-data pipelines (toxicity, near-duplicates, decontamination, ...).

Nothing outside this subpackage imports it; it can be deleted without touching the rest of the library.
"""
