"""Readers and writers with explicit schemas and null policies."""
