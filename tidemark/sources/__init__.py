"""Reading, guarded publishing and reconciliation of tables."""
