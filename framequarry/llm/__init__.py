"""Operators for preparing training text: ten documented operators and their queries.

Nothing outside this subpackage imports it.
"""
