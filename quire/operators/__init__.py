"""Operators that several plans share."""
