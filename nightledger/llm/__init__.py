"""Training-data operators: one module for each, plus ``queries`` which registers them."""
