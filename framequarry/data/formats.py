"""Formats, codecs and tags."""

# Fixed values: (name, extension, MIME type, decodable, encodable) of the standard formats.
FORMATS = [
    ("GIF", "gif", "image/gif", True, False),
    ("JPEG", "jpg", "image/jpeg", True, True),
    ("PNG", "png", "image/png", True, True),
    ("WebP", "webp", "image/webp", True, True),
    ("JXL", "jxl", "image/jxl", True, True),
    ("TIFF", "tiff", "image/tiff", True, False),
    ("AVIF", "avif", "image/avif", True, True),
    ("HEIC", "heic", "image/heic", True, False),
    ("SVG", "svg", "image/svg+xml", True, False),
    ("APV", "apv", "video/apv", False, False),
    ("PPM", "ppm", "image/x-portable-pixmap", True, False),
]

# Further extensions.
ALIASES = {"jpeg": "JPEG", "jpe": "JPEG", "jfif": "JPEG", "tif": "TIFF", "heif": "HEIC", "svgz": "SVG", "pgm": "PPM", "pnm": "PPM", "pam": "PPM", "pfm": "PPM"}
EXTENSIONS = {f[1]: f[0] for f in FORMATS} | ALIASES

# EXIF tags that metadata is made of.
TAGS = {
    "width": 0x0100, "height": 0x0101, "make": 0x010F, "model": 0x0110, "orientation": 0x0112, "exposure_time": 0x829A,
    "f_number": 0x829D, "iso": 0x8827, "datetime_original": 0x9003, "focal_length": 0x920A,
}

#: What this engine itself reads or writes pixels of; the others are probed and sniffed only.
CODECS = [
    ("png/zlib", "decode"), ("gif/lzw", "decode"), ("tiff/plain", "decode"), ("ppm/plain", "decode"), ("jpeg/dct", "decode"), ("ljpeg/plain", "decode"),
    ("png/zlib", "encode"), ("dng/plain", "encode"), ("ppm/plain", "encode"),
]

# Default options of the encoders, as (format, option, value).
ENCODE_DEFAULTS = [
    ("png", "compression", "default"),
    ("png", "filter", "min_sum_abs"),
    ("png", "auto_reduce", "false"),
    ("jpeg", "quality", "90"),
    ("jpeg", "subsampling", "4:2:0"),
    ("jpeg", "progressive", "false"),
    ("jpeg", "restart_interval", "0"),
    ("jpeg", "density", "1:1"),
    ("webp", "mode", "lossy"),
    ("webp", "quality", "75"),
    ("avif", "lossless", "true"),
    ("avif", "quality", "80"),
    ("jxl", "lossless", "true"),
    ("jxl", "distance", "1.0"),
    ("jxl", "effort", "7"),
    ("jxl", "container", "false"),
    ("common", "metadata", "all"),
    ("common", "bit_depth", "16"),
]

# Named colour descriptions, as (name, code of the primaries, code of the transfer curve).
COLOR_DESCRIPTIONS = [("sRGB", 1, 13), ("Linear sRGB", 1, 8), ("Display P3", 12, 13), ("Rec. 2020", 9, 2), ("Unspecified", 2, 2)]
