"""Operators and queries for building training corpora; nothing else in the library imports them."""
