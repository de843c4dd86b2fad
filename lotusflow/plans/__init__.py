"""Queries of the engine and the SQL that checks them."""
