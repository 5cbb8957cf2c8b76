"""Incrementally maintained reports."""
