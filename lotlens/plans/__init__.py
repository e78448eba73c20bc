"""Logical plans of whole runs, and the catalogue of registered queries."""
