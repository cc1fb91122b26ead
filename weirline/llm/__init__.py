"""Operators for preparing training corpora: each is a DataFrame transformation."""
