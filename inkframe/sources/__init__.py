"""Readers and writers of annotation, detection, embedding and label files."""
