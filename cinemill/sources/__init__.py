"""Readers, writers and the views that derive the media library from the driver's tables."""
