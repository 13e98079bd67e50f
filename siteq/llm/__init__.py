"""Operators for preparing training text: quality, dedup, joins, search, mixing, formatting.

Nothing else in siteq imports this subpackage.
"""
