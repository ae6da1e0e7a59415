"""Training-data operators: ten methods over text tables, kept apart from the proofreading engine.

Nothing outside this subpackage imports it. ``queries.py`` holds the registered queries
and ``oracles.py`` their SQL.
"""
