"""Operators for preparing training text: each module is one operator, ``catalogue`` its queries."""
