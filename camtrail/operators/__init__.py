"""Operators over detections, frames and results."""
