"""Operators for building language-model training data; ``queries`` registers one query for each."""
