"""Jobs and new files as streams."""
