"""Readers, writers and the evidence views that are derived from the driver's tables."""
