"""Relational operators over wordlists: DataFrames of word forms keyed by id, doculect and concept."""
