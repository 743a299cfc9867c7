"""Operators that prepare text for language models. Nothing else in the library imports this."""
