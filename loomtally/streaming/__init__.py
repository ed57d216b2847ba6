"""Streaming use of the engine.

There are no streaming operators of its own: all column functions are stateless per row, so they apply to a `readStream` frame as they are,
and `totals` runs on one as any grouped aggregate does.
"""
