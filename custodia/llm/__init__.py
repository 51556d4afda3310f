"""Operators of a training-data pipeline over text and vector tables.

Each module holds one operator; ``queries`` registers them over the given
tables. Nothing else in the library imports this subpackage.
"""
