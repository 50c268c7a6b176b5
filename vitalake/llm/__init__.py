"""Operators for the data of language models; nothing else in the package imports this."""
