"""Readers, writers, generators, and matrices derived from warehouse tables."""
