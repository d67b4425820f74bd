"""Relational operators over sections, terms, concepts and the library."""
