"""Operators for text corpora.  Nothing else in this library imports this subpackage."""
