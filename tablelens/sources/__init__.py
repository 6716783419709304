"""Readers of files and databases."""
