"""sources of the price-pattern engine."""
