"""Relational operators over events, hierarchies and links."""
