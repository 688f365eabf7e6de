"""Query registry and plan helpers (bounded broadcast, distributed numbering)."""
