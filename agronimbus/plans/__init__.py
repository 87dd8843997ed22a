"""Whole jobs, shared storage for intermediate tables, and registered queries."""
