"""Catalogue, history, verification, estimate, reconciliation and audit operators over DataFrames."""
