"""Operators on DataFrames: counts, tokens, collocations, dictionaries, similarity, rules, ranking, models."""
