"""Structured Streaming forms of the recorder: gestures, frame matching, monitoring, windows."""
