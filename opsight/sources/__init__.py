"""Table sources: driver tables, fixture adapters, external readers."""
