"""Operators of a training-data pipeline: whole tables of documents in, decisions per document out."""
