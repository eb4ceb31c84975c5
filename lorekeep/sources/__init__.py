"""Readers, writers and the views that test tables stand in for."""
