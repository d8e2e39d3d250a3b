"""sources of siltscope."""
