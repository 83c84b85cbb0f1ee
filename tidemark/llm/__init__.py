"""Corpus preparation for training data: ten operators, each in a module of its own.

Nothing outside this folder imports it, so the rest of the library works without it.
"""
