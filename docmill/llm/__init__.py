"""Operators a large training-data pipeline needs (see README, "llm").

Nothing outside this subpackage imports it.
"""
