"""Registered queries: each pairs an operator with SQL that gives the same answer."""
