"""Readers and writers of the interchange formats."""
