"""Readers, normalisation, storage, and logs derived from the sample tables."""
