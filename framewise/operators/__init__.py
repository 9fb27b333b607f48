"""Framewise operators."""
