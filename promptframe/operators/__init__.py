"""DataFrame operators: tables, grid, result store, usage, answers, retrieval, reports."""
