"""Operators for building language-model training data at corpus scale.

Each module holds one operator with its own general interface; ``queries``
holds the thin registered queries and their SQL.  Nothing outside this
subpackage imports it.
"""
