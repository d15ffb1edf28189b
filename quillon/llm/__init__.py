"""Operators for preparing training corpora: dedup, filtering, tokenisation, storage."""
