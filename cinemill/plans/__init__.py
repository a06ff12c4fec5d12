"""Policies lowered to Columns, and the registered queries."""
