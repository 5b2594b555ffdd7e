"""Dictionaries that ship with the package."""
