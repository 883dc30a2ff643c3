"""Where tables come from and where bytes go."""
