"""Readers: landed documents, inventories, sync documents, tables, serving snapshots."""
