"""Readers, writers and the mapping of the TPC-H-like star onto the retail model."""
