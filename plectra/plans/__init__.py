"""Query registry: one entry per operator, with its SQL twin."""
