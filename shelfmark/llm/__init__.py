"""Operators for cleaning and preparing text corpora; nothing else in the library imports this subpackage."""
