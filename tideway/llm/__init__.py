"""Operators for building language-model training data, each a DataFrame -> DataFrame step."""
