"""Structured Streaming forms of the movement steps."""

from custodia.streaming.movement import stream_movement

__all__ = ["stream_movement"]
