"""Operators for large text corpora: near duplicates, secrets, language-model scores, filters, tokens and shards."""
