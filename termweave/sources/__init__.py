"""Readers and writers of the linker's tables and text formats."""
