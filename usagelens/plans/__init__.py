"""Jobs that combine operators: refresh, serving snapshot, reports."""
