"""Operators over a Twin; each returns a lazy DataFrame."""
