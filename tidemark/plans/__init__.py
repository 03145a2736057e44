"""Compositions: silver and gold tables, star schema, metrics, end-to-end runs."""
