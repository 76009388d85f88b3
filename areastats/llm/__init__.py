"""Operators for preparing training text at scale.

Nothing else in the library imports this package. `queries` registers one query per
operator; each module holds one operator with its own general interface.
"""
