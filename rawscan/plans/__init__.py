"""Driver-side planning: literals, decomposition into raw filters, cascade choice."""
