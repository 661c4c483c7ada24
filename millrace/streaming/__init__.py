"""The language over streams: one pass over files, continued over files that come later."""

from .continuous import add_stream, start

__all__ = ["add_stream", "start"]
