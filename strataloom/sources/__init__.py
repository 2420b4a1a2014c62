"""Stored histories, catalogs and interchange files."""
