"""Readers, writers and the binding of the driver's tables to the
reference's column vocabulary."""
