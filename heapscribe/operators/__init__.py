"""Relational operators of trace analytics, for any DataFrame with the named columns."""
