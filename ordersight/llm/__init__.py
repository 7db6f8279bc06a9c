"""Operators of a training-data pipeline over large text tables; nothing else in the library imports them."""
