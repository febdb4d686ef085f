"""Relational, graph and keyed-write operators."""
