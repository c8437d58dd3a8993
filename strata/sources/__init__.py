"""Readers and writers of grids, points and results."""
