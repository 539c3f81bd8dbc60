"""Plans: building, publishing and opening snapshots."""
