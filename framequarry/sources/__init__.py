"""Where frames and files come from: binary files, and frames derived from the driver's tables."""
