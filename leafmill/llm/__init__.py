"""Operators for preparing language-model training data at corpus scale.

Nothing outside this subpackage imports it.  ``queries.py`` holds the thin
``opN_*`` queries that bind each operator to the tables of a data folder.
"""
