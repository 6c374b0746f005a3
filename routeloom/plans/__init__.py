"""Whole detections, composed of operators into one lazy plan."""
