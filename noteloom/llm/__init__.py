"""Operators for preparing large text corpora and vector tables.

Nothing outside this subpackage imports it.
"""
