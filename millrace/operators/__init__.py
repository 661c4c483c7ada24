"""Row operators that take more than one DataFrame call."""
