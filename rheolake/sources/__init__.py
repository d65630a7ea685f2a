"""Sources: case tables, phantoms, adapters of plain tables."""
