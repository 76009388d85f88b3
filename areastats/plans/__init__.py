"""Whole reports put together from operators."""
