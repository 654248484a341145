"""Registered queries, their test projection and their SQL."""
