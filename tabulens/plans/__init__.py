"""Registered queries: thin plans over the operators."""
