"""Filters, windows, result store, frontier, profiles, classification."""
