"""streaming of siltscope."""
