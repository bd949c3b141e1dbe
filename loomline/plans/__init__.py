"""Registered queries: each module holds `QUERIES` and the matching `ORACLE` texts."""
