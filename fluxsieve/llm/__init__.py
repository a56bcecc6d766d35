"""Operators of a large-scale training-data pipeline.

Nothing else in the library imports this subpackage.  Each module holds one operator by
the method its docstring names; ``queries.py`` registers one query per operator.
"""
