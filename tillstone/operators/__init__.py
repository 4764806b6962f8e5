"""Distributed building blocks that hold when one key or value dominates the data."""
