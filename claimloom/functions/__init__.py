"""Lexicons and column functions."""
