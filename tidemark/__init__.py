"""DataFrame operators for large collections of labelled, dated records."""
