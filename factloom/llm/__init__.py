"""Operators for training data: neighbours, canonical names, token ids, leaks and languages. Nothing outside imports this package."""
