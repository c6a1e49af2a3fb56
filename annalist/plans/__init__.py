"""Query plans over the history model."""
