"""Readers, writers and the parsing of caption formats."""
