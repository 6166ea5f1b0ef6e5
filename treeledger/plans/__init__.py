"""Jobs that wire the operators together."""
