"""Landed files to typed tables, sinks, work lists."""
