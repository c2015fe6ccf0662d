"""Readers, file filters and parsers of service answers."""
