"""Operators for large-scale training-data preparation.

Nothing outside this subpackage imports it; the driver entry point adds its
queries only when the subpackage is present.
"""
