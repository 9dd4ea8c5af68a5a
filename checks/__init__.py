"""Registered queries and the SQL that each of them must equal."""
