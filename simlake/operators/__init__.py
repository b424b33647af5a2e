"""simlake: operators."""
