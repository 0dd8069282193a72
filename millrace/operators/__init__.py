"""Relational operators over the preference-data model."""
