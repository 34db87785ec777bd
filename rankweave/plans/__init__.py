"""Registered queries, whole experiments and the command line."""
