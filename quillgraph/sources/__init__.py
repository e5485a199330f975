"""Readers for dumps, SQL table dumps, published documents and curated tables."""
