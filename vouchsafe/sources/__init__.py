"""Readers and writers for the data zones."""
