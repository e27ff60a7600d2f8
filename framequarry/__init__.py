"""A PySpark-native engine for still images and camera RAW data: images are rows."""
