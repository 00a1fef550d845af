"""Operators for large text corpora: scans, filters, duplicates, packing, token files."""
