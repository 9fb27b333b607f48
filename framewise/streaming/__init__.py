"""Framewise streaming."""
