"""Front ends: source files to program facts."""
