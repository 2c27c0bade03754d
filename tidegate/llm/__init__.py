"""Operators for preparing training data: texts, pages, conversations and vectors."""
