"""Operators for large text corpora: filtering, de-duplication, mixing and token output."""
