"""Where catalog metadata comes from and where snapshots go."""
