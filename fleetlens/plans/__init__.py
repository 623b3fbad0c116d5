"""Helpers that shape plans: shared folders, fixpoints, connected components."""
