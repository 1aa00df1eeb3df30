"""Operators for preparing large text corpora, self-contained in this subpackage.

Nothing outside this folder imports it; it may be deleted without touching the rest.
"""
