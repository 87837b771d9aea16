"""How plans are laid out: row positions, skew, names, and config-driven jobs."""
