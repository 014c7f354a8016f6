"""Readers and writers of sequence, alignment, annotation and rule files."""
