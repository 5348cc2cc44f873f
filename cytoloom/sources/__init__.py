"""Readers, writers and the views bound to the test tables."""
