"""Relational operators: materialisation, connected components, similarity joins."""
