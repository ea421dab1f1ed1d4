"""operators of the price-pattern engine."""
