"""Quillon operators."""
