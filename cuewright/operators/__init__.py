"""Relational operators over transcript tables."""
