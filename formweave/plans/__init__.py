"""Whole flows: files to documents, documents to reports."""
