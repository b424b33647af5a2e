"""simlake: analyze."""
