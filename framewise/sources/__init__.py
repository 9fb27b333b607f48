"""Framewise sources."""
