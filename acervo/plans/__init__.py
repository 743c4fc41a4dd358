"""Registered queries; importing a ``*_queries`` module fills the registry."""
