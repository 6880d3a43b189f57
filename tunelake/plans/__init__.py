"""Whole searches and reports composed from the operators."""
