"""Operators of a training-data pipeline over documents, labels, benchmark items and embeddings."""
