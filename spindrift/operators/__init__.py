"""Relational operators over manifests, predictions and pairs."""
