"""Operators on text corpora: language, duplicates, shards, tokens, chats, leaks, vectors, personal data."""
