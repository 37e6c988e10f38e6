"""Training-data operators for document corpora.

Nothing outside this subpackage imports it; ``__spark_entry__.py`` adds its
queries only when it is present.
"""
