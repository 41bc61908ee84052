"""Readers, schemas, writers and the shared scratch folder."""
