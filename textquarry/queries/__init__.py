"""Registered queries: each module has QUERIES, a dict of name: (function of (spark, sf_dir), SQL or None)."""
