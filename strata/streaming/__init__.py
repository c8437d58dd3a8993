"""Wells and measurements that arrive as streams."""
