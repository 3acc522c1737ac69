"""Writers of frames."""
