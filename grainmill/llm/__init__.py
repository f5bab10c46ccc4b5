"""Operators for corpora at cluster scale; nothing outside this folder imports them."""
