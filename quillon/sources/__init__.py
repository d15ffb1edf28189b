"""Quillon sources."""
