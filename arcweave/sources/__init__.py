"""Readers, writers, the catalog and the data generator."""
