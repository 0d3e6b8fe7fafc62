"""Registered queries over the domain binding, each with its SQL counterpart."""
