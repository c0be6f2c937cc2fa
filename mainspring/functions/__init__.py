"""Byte and picture functions."""
