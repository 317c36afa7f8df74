"""Readers, sinks and the mapping from an order-line star schema to a security panel."""
