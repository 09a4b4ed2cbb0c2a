"""Relational operators over mapped images."""
