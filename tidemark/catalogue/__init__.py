"""Registered queries on the shared test tables, each with its SQL twin where SQL can express it."""
