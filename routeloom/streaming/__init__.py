"""Windows of a live stream of points (an extension of the batch engine)."""
