"""Readers, writers and schema upkeep."""
