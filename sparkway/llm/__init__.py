"""Training-data operators: sharding, language id, deduplication, tokenising, scoring, scans.

Nothing else in the library imports this subpackage.
"""
