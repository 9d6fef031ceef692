"""Operators for preparing training data at scale.

Nothing outside this subpackage imports it.  ``queries`` holds the registered
queries, each a thin wrapper that derives digest columns from the real outputs
of the operator modules beside it.
"""
