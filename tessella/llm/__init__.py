"""Training-data operators for large text corpora; nothing else in the package imports this one."""
