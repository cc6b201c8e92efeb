"""Registered queries, each beside the SQL that states its result."""
