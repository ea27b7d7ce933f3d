"""Bounded and continuous streams."""
