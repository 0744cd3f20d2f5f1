"""Plan-level helpers: lineage cuts, skew-safe lookups, global-order windows."""
