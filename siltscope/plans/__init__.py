"""plans of siltscope."""
