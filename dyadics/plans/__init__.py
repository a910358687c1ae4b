"""Queries on the driver tables: relations of paired choices derived from them, and what is computed of these."""
