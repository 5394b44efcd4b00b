"""Registered queries, one per inventory id, each with its check SQL."""
