"""Operators of a training-data pipeline (numbered 1 to 10) and their queries.

Nothing else in the library imports this subpackage.
"""
