"""Operators of a training-data pipeline over document tables.

Nothing outside this subpackage imports it.
"""
