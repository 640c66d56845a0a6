"""Operators for building training corpora from documents, pages, vectors and conversations."""
