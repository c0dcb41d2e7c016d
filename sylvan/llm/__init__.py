"""Training-data operators: fingerprints, language ID, deduplication, scans, rules, packing, tokens.

Nothing outside this subpackage imports it. ``queries.py`` holds the registered queries, the other
modules hold one operator each with a general interface.
"""
