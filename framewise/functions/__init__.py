"""Framewise functions."""
