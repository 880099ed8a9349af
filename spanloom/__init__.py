"""Span, label and corpus analytics expressed as Spark DataFrame transformations."""
