"""Operators for preparing language-model training data, with their registered queries.

Nothing outside this package imports it; ``__spark_entry__.py`` adds its queries when it is present.
"""
