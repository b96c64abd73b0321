"""Training-data operators: each module holds one operator and its registered query.

Nothing outside this subpackage imports it.  See :mod:`tessera.llm.queries` for the
query registry that ``__spark_entry__.py`` picks up when the subpackage is present.
"""
