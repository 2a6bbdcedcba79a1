"""Operators that prepare training data: splitting, selection, neighbours, percentiles, cleaning, encoding.

Nothing outside this subpackage imports it; its queries are added to the entry point only if it is present.
"""
