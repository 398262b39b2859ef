"""Readers for landed map layers, and the writers for derived ones."""
