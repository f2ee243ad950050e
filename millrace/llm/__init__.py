"""Operators for preparing training corpora at scale; nothing else in the package imports this."""
