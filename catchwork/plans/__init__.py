"""Plan-level helpers: checkpoints, size checks, iterative graph plans."""
