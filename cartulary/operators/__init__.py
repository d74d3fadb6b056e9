"""DataFrame-in, DataFrame-out operators over catalog metadata."""
