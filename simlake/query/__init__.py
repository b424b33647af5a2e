"""simlake: query."""
