"""simlake: streaming."""
