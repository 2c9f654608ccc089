"""DataFrame -> DataFrame operators: parsers, filters, transforms, statistics, batching."""
