"""Readers, samples and writers."""
