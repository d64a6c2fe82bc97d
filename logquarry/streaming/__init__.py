"""Following files that grow, and alerts on what they gain."""
