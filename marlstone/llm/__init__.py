"""Training-data operators: ten corpus-scale steps and the queries that apply them.

Nothing outside this subpackage imports it.  ``queries`` holds the thin
registered queries, the other modules hold the operators themselves.
"""
