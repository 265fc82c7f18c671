"""Operators for training-data pipelines; nothing else in the library imports this package.

Each operator takes DataFrames, selects the columns it needs by name and returns a
DataFrame; ``queries.py`` applies each to a whole table. Intermediate tables go to the
shared folder of ``citegrid.session.Scratch``.
"""
