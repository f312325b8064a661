"""Composed queries (dashboard tabs, notebooks) and their SQL oracle."""
