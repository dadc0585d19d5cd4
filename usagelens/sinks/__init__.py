"""Writers: keyed tables, history, published snapshots."""
