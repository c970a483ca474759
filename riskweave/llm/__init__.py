"""Operators for large training-data pipelines; see the module docstrings for their contracts."""
