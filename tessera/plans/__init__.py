"""Logical plans: schemas, the extraction step and the fact tables that operators read."""
