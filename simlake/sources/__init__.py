"""simlake: sources."""
