"""Operators of a training-data pipeline: language ID, SimHash near-dedup,
packing, source mixing, exact and approximate vector search, toxicity, chat
formatting, personal data and language-model scoring.

Nothing outside this subpackage imports it.
"""
