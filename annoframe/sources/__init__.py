"""Readers and writers: tables, shard folders, side files."""
