"""Operators that prepare training data: packing, search, media, PII, dedup and so on.

Nothing outside this subpackage imports it; ``queries`` holds its registered
queries and ``oracle`` their SQL twins.
"""
