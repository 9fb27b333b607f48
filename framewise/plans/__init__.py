"""Framewise plans."""
