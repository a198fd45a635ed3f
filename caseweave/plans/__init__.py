"""Registered queries: operators applied to tables, with equivalent SQL."""
