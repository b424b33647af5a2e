"""simlake: report."""
