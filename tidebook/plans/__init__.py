"""Registered queries and text renderers."""
