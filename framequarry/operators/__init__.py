"""Image operators over DataFrames. Pixel form: a row per pixel. Array form: a row per frame."""
