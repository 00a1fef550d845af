"""Incremental runs over folders that grow shard by shard."""
