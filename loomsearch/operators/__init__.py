"""Operators over documents, postings, results and logs."""
