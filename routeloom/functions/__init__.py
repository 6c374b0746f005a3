"""Column functions: time windows, geometry and the line-distance kernel."""
