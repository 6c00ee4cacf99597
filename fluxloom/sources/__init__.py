"""Readers, writers, and scene catalogue planning."""
