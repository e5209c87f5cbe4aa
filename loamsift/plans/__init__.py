"""Whole flows."""
