"""Relational building blocks: selection, ranking, paging, keyed upsert and statistics."""
