"""Relational operators over fact tables.  Each takes :class:`~tessera.plans.facts.Facts` and returns a DataFrame."""
