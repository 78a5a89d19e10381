"""Registered queries: the operators applied to the given tables, each with its SQL counterpart."""
