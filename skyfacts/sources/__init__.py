"""Readers, writers, the catalog and prepared datasets."""
