"""Training-data operators: ten dealt operators, each in a module of its own.

Nothing outside this subpackage imports it.  ``queries`` holds the thin ``opN_*`` wrappers.
"""
