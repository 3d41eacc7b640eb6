"""Relational and text operators of the engine."""
