"""Camera, illuminant and colour values."""

# Camera matrices, XYZ to camera, row by row; illuminants are EXIF codes.
# (model, matrix 1 or None, illuminant 1 or None, matrix 2, illuminant 2), in order of lookup.
CAMERAS = [
    ("ILCE-7RM5", None, None, [0.8200, -0.2976, -0.0719, -0.4296, 1.2053, 0.2532, -0.0429, 0.1282, 0.5774], 21),
    ("ILCE-7RM4", None, None, [0.7411, -0.2508, -0.0559, -0.4571, 1.2162, 0.2710, -0.0533, 0.1440, 0.6226], 21),
    ("ILCE-7M4", None, None, [0.7460, -0.2365, -0.0588, -0.5687, 1.3442, 0.2474, -0.0624, 0.1156, 0.6584], 21),
    ("ILCE-7SM3", None, None, [0.6912, -0.2127, -0.0469, -0.4470, 1.1966, 0.2819, -0.0518, 0.1390, 0.6726], 21),
    ("ILCE-1", None, None, [0.7803, -0.2768, -0.0621, -0.5009, 1.2742, 0.2615, -0.0666, 0.1561, 0.6404], 21),
    ("ILCE-6700", None, None, [0.6972, -0.2408, -0.0600, -0.4330, 1.2101, 0.2515, -0.0388, 0.1277, 0.5847], 21),
    ("Canon EOS R5", None, None, [0.9766, -0.3149, -0.0825, -0.5765, 1.3592, 0.2392, -0.0862, 0.1548, 0.6405], 21),
    ("Canon EOS R6", None, None, [0.8616, -0.2350, -0.0791, -0.5765, 1.3592, 0.2392, -0.0862, 0.1548, 0.6405], 21),
    ("Canon EOS 5D Mark IV", None, None, [0.6446, -0.0366, -0.0864, -0.4436, 1.2204, 0.2513, -0.0952, 0.2496, 0.6348], 21),
    ("Canon EOS R3", None, None, [0.8197, -0.2503, -0.0804, -0.4289, 1.2316, 0.2222, -0.0505, 0.1349, 0.5791], 21),
    ("Nikon Z 6", None, None, [0.7872, -0.2439, -0.0966, -0.5811, 1.3589, 0.2480, -0.1197, 0.2268, 0.7116], 21),
    ("Nikon Z 7", None, None, [0.7636, -0.2576, -0.1027, -0.5765, 1.3555, 0.2476, -0.1292, 0.2406, 0.6988], 21),
    ("Nikon D850", None, None, [1.0405, -0.3755, -0.1270, -0.5461, 1.3787, 0.1793, -0.1040, 0.2015, 0.6785], 21),
    ("Nikon Z 8", None, None, [0.8527, -0.2868, -0.0960, -0.5037, 1.2684, 0.2642, -0.0660, 0.1187, 0.5986], 21),
    ("Nikon Z 9", None, None, [0.8527, -0.2868, -0.0960, -0.5037, 1.2684, 0.2642, -0.0660, 0.1187, 0.5986], 21),
    ("Fujifilm X-T5", None, None, [1.1210, -0.4957, -0.0988, -0.3603, 1.1710, 0.2177, -0.0426, 0.1143, 0.5851], 21),
    ("Fujifilm X-H2", None, None, [1.1210, -0.4957, -0.0988, -0.3603, 1.1710, 0.2177, -0.0426, 0.1143, 0.5851], 21),
    ("Fujifilm X-T4", None, None, [1.0862, -0.4721, -0.0860, -0.3310, 1.1261, 0.2325, -0.0379, 0.1082, 0.5765], 21),
    ("Fujifilm X100V", None, None, [1.1434, -0.5063, -0.1041, -0.3604, 1.1715, 0.2172, -0.0551, 0.1356, 0.5811], 21),
    ("iPhone 13 Pro Max", [1.2270, -0.5450, -0.2610, -0.4550, 1.5180, -0.0430, -0.0410, 0.1640, 0.5910], 17, [0.9150, -0.3220, -0.1260, -0.4290, 1.3100, 0.0950, -0.1060, 0.2350, 0.4310], 21),
    ("iPhone 14 Pro Max", [1.2610, -0.5780, -0.2550, -0.4420, 1.5000, -0.0380, -0.0450, 0.1710, 0.5820], 17, [0.9320, -0.3420, -0.1320, -0.4180, 1.2980, 0.0960, -0.0980, 0.2250, 0.4410], 21),
    ("iPhone 15 Pro Max", [1.2850, -0.6020, -0.2430, -0.4310, 1.4900, -0.0300, -0.0380, 0.1450, 0.6120], 17, [0.9450, -0.3610, -0.1350, -0.4100, 1.2930, 0.0870, -0.0960, 0.2100, 0.4590], 21),
    ("iPhone 16 Pro Max", [1.3092, -0.6653, -0.2359, -0.4257, 1.4791, -0.0241, -0.0360, 0.1377, 0.6341], 17, [0.9564, -0.3793, -0.1339, -0.4043, 1.2963, 0.0853, -0.0940, 0.2064, 0.4659], 21),
    ("iPhone 16 Pro", [1.3092, -0.6653, -0.2359, -0.4257, 1.4791, -0.0241, -0.0360, 0.1377, 0.6341], 17, [0.9564, -0.3793, -0.1339, -0.4043, 1.2963, 0.0853, -0.0940, 0.2064, 0.4659], 21),
]

# Fixed values: (name, EXIF code, correlated colour temperature, x, y), in order of lookup.
ILLUMINANTS = [
    ("Standard Illuminant A", 17, 2856, 0.44757, 0.40745),
    ("Cool White Fluorescent", 15, 4150, 0.37510, 0.36714),
    ("D50", 23, 5003, 0.34567, 0.35850),
    ("D55", 20, 5503, 0.33242, 0.34743),
    ("D65", 21, 6504, 0.31271, 0.32902),
    ("D75", 22, 7504, 0.29902, 0.31485),
]

# Colour constants, row by row. The profile white point is kept as published there.
CONSTANTS = {
    "pcs_whitepoint": [0.9505, 1.0000, 1.0890],
    "srgb_primaries": [0.6400, 0.3300, 0.3000, 0.6000, 0.1500, 0.0600],
    "srgb_to_xyz_d65": [0.4124564, 0.3575761, 0.1804375, 0.2126729, 0.7151522, 0.0721750, 0.0193339, 0.1191920, 0.9503041],
    "xyz_d65_to_srgb": [3.2404542, -1.5371385, -0.4985314, -0.9692660, 1.8760108, 0.0415560, 0.0556434, -0.2040259, 1.0572252],
    "adobe_rgb_primaries": [0.6400, 0.3300, 0.2100, 0.7100, 0.1500, 0.0600],
    "bradford_d65_to_d50": [1.0478112, 0.0228866, -0.0501270, 0.0295424, 0.9904844, -0.0170491, -0.0092345, 0.0150436, 0.7521316],
    "bradford_d50_to_d65": [0.9555766, -0.0230393, 0.0631636, -0.0282895, 1.0099416, 0.0210077, 0.0122982, -0.0204830, 1.3299098],
}
XYZ_TO_SRGB = CONSTANTS["xyz_d65_to_srgb"]

#: Layouts of the 2 x 2 colour filter, row by row.
BAYER = ["RGGB", "GRBG", "BGGR", "GBRG"]
