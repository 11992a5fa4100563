"""Registered queries of the linker."""
