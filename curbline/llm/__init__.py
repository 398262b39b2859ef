"""Operators that prepare texts for training; nothing else in the library imports them."""
