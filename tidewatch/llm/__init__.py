"""Operators for large training corpora, over the tables documents, pages and labels."""
