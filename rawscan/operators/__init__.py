"""Record filters, JSON predicates, search and statistics as DataFrame expressions."""
