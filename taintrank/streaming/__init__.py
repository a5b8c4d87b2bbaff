"""Streaming use of the stateless operators.

The reference has no streaming code (no watermark, window or state); the
stateless operators (P*, J3, J6, J8, K7) accept a streaming frame as they
are. This package only wires them to a source and a checkpointed sink.
"""
