"""Uploads that land in a folder, as a stream."""
