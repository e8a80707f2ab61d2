"""Operators of a training-data pipeline over large text tables.

Nothing else in the library imports this subpackage. Every operator takes a DataFrame and the names
of its id and text columns, reads only those, and returns a DataFrame; other columns, whatever their
names, are never touched. A null text counts as empty, an empty table gives an empty result.
"""
