"""Whole stages put together, and the catalogue of registered queries."""
