"""Relational and graph operators of the engine."""
