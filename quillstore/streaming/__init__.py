"""Refresh: following a pointer, downloading new versions, swapping views."""
