"""Filters as relations: bit filters, counting filters, multi-index filters, classification."""
