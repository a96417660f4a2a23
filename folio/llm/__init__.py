"""Operators for preparing language-model training text, one module each.

Nothing else in the library imports this subpackage.  ``queries`` holds the
registered queries and their SQL; ``corpus_pipeline`` at the repository top
chains five of the operators.
"""
