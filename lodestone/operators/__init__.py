"""DataFrame operators: indexing, ranking, paging, and many queries at once."""
