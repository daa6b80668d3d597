"""Where events and tables come from, and where results go."""
