"""Operators for large training corpora.

Nothing outside this package imports it; deleting the folder leaves the code-quality engine whole.
"""
