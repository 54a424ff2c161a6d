"""Walking the hierarchy: joins between adjacent levels, filters, and typed frames."""
