"""Where source rows come from: a tree of files, or tables."""
