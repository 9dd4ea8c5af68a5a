"""DataFrame-to-DataFrame operators: checks, encoding, selection, neighbours, metrics, reports."""
