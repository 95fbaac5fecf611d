"""Operators for building training corpora out of documents and vectors."""
