"""Operators of a training-data pipeline over ``documents(doc_id, text, ...)``."""
