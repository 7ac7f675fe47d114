"""Operators for preparing language-model training text at scale.

Ten operators and the queries that apply them to whole tables. Nothing outside this subpackage imports it.
"""
