"""Streaming ingest of delimited drops.

The reference loads one file at a time and has no streaming operator. The one piece that
carries over is the delimited source itself: new files landing in a folder can be parsed
with the same line rules as :func:`quarry.sources.delimited.read_delimited`, as a file
stream, once the header and delimiter are known (from a first file or given).
"""

from quarry.streaming.delimited_stream import stream_delimited

__all__ = ["stream_delimited"]
