"""Operators for preparing large text corpora, kept apart from the relational engine."""
