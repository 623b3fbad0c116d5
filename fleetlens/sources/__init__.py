"""Readers and writers of metadata artifacts: explicit schemas, nothing inferred."""
