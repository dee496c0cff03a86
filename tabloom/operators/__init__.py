"""Operators over table rows, cells, words and lines."""
