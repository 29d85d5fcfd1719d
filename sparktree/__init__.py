"""Spatial-tree analytics as DataFrame queries."""
