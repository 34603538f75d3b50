"""Readers and connectors: file trees, text tables, fixtures, embedders."""
