"""Operators for large training corpora.  Nothing outside this folder imports them."""
