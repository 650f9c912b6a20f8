"""Schemas, field paths and types: everything that is decided before a plan is built."""
