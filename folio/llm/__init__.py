"""Operators that prepare training text: filter, deduplicate, classify, tokenise, pack."""
