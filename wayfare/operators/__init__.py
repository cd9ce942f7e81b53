"""Graph operators over edges(src, dst, w): statistics, indexes, walks, pushes, updates and metrics."""
