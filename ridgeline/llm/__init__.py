"""Operators on text corpora, conversations, pages and embeddings for preparing training data."""
