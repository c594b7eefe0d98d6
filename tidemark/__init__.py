"""Tidemark: market-bar analytics as Spark DataFrame transformations."""

from tidemark.session import prepare, settle

__all__ = ["prepare", "settle"]
