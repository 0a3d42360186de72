"""Readers and writers of published text tables."""
