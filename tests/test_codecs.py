"""Codecs by round trip: small encoders here write what the decoders must read."""

import struct
import zlib

import numpy as np
import pytest

from framequarry.operators import codecs, embedded, formats, ifd
from framequarry.operators.codecs import Unreadable
from framequarry.streaming import ingest
from tests.files import tiff as tree_file

RNG = np.random.default_rng(7)


def png(w, h, kind, bits, values, palette=None, filters=(0, 1, 2, 3, 4), interlaced=False):
    """values: (h, w, channels); each row filtered by one of the given kinds."""
    channels = values.shape[2]
    back = max(1, channels * bits // 8)

    def packed(v):
        if bits == 16:
            return v.astype(">u2").reshape(v.shape[0], -1).view(np.uint8)
        if bits == 8:
            return v.astype(np.uint8).reshape(v.shape[0], -1)
        flat = v.reshape(v.shape[0], -1)
        pad = -flat.shape[1] % (8 // bits)
        flat = np.pad(flat, ((0, 0), (0, pad))).reshape(v.shape[0], -1, 8 // bits)
        return (flat << np.arange(8 - bits, -1, -bits)).sum(axis=2).astype(np.uint8)

    def filtered(lines):
        out, above = b"", np.zeros(lines.shape[1], int)
        for y, line in enumerate(lines.astype(int)):
            kind_, left = filters[y % len(filters)], np.concatenate((np.zeros(back, int), line[:-back] if len(line) > back else line[:0]))[: len(line)]
            corner = np.concatenate((np.zeros(back, int), above[:-back] if len(line) > back else above[:0]))[: len(line)]
            p = left + above - corner
            paeth = np.where((abs(p - left) <= abs(p - above)) & (abs(p - left) <= abs(p - corner)), left, np.where(abs(p - above) <= abs(p - corner), above, corner))
            guess = [0, left, above, (left + above) // 2, paeth][kind_]
            out += bytes([kind_]) + ((line - guess) & 255).astype(np.uint8).tobytes()
            above = line
        return out

    if interlaced:
        raw = b"".join(filtered(packed(values[y0::dy, x0::dx])) for x0, y0, dx, dy in codecs.PASSES if values[y0::dy, x0::dx].size)
    else:
        raw = filtered(packed(values))
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + bytes(4)
    head = chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, bits, kind, 0, 0, int(interlaced)))
    return b"\x89PNG\r\n\x1a\n" + head + (chunk(b"PLTE", palette.tobytes()) if palette is not None else b"") + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


@pytest.mark.parametrize("interlaced", [False, True])
@pytest.mark.parametrize(("kind", "bits"), [(0, 1), (0, 2), (0, 4), (0, 8), (0, 16), (2, 8), (2, 16), (3, 1), (3, 4), (3, 8), (4, 8), (4, 16), (6, 8), (6, 16)])
def test_png_layouts(kind, bits, interlaced):
    w, h, channels = 11, 9, codecs.PNG_CHANNELS[kind]
    v = RNG.integers(0, 1 << bits, (h, w, channels))
    palette = RNG.integers(0, 256, (256, 3)).astype(np.uint8) if kind == 3 else None
    gw, gh, rgb = codecs.decode_png(png(w, h, kind, bits, v, palette, interlaced=interlaced))
    if kind == 3:
        want = palette[v[:, :, 0]].astype(int) * 257
    else:
        scaled = v * (65535 // ((1 << bits) - 1)) if bits < 16 else v
        want = np.repeat(scaled[:, :, :1], 3, axis=2) if channels < 3 else scaled[:, :, :3]
    assert (gw, gh) == (w, h) and np.array_equal(rgb.reshape(h, w, 3), want)


@pytest.mark.parametrize("bits", [8, 16])
def test_own_png_and_ppm(bits):
    rgb = RNG.integers(0, 65536, (35, 3))
    want = rgb if bits == 16 else (rgb >> 8) * 257
    for enc, dec in ((codecs.encode_png, codecs.decode_png), (codecs.encode_ppm, codecs.decode_ppm)):
        w, h, got = dec(enc(7, 5, rgb, bits))
        assert (w, h) == (7, 5) and np.array_equal(got, want)
    with pytest.raises(Unreadable):
        codecs.encode_png(7, 5, rgb, 10)


@pytest.mark.parametrize("bad", [b"", b"\x89PNG\r\n\x1a\n", codecs.encode_png(4, 4, np.zeros((16, 3), int))[:-30]])
def test_broken_png(bad):
    with pytest.raises((Unreadable, zlib.error, struct.error)):
        codecs.decode_png(bad)


def test_ppm_kinds():
    assert codecs.decode_ppm(b"P5 # c\n2 1\n255\n\x01\xff")[2].tolist() == [[257] * 3, [65535] * 3]
    assert codecs.decode_ppm(b"P7\nWIDTH 1\nHEIGHT 1\nDEPTH 4\nMAXVAL 255\nTUPLTYPE RGB_ALPHA\nENDHDR\n\x01\x02\x03\x04")[2].tolist() == [[257, 514, 771]]
    pfm = b"Pf\n1 2\n-1.0\n" + struct.pack("<2f", 0.25, 2.0)  # rows from the bottom
    assert codecs.decode_ppm(pfm)[2][:, 0].tolist() == [65535, 16383]


def lzw_little(codes, start):
    """Codes as bits of one width: a clear before the table can grow."""
    out, acc, have = bytearray(), 0, 0
    for c in codes:
        acc |= c << have
        have += start + 1
        while have >= 8:
            out.append(acc & 255)
            acc >>= 8
            have -= 8
    return bytes(out) + bytes([acc & 255])


def gif(w, h, frame, left, top, palette, interlaced=False, screen=(6, 5)):
    codes = []
    for i, v in enumerate(frame.ravel().tolist()):
        if i % 2 == 0:
            codes.append(8)
        codes.append(v)
    data = lzw_little([*codes, 9], 3)
    blocks = b"".join(bytes([len(data[i : i + 255])]) + data[i : i + 255] for i in range(0, len(data), 255)) + b"\0"
    comment = b"\x21\xfe\x02hi\0"
    return b"GIF89a" + struct.pack("<HHBBB", *screen, 0x82, 0, 0) + palette.tobytes() + comment + b"\x2c" + struct.pack("<HHHHB", left, top, w, h, 0x40 if interlaced else 0) + b"\x03" + blocks + b";"


@pytest.mark.parametrize("interlaced", [False, True])
def test_gif_frame_on_black(interlaced):
    palette, frame = RNG.integers(0, 256, (8, 3)).astype(np.uint8), RNG.integers(0, 8, (4, 3))
    stored = frame[[0, 2, 1, 3]] if interlaced else frame  # passes of four rows: 0, then 2, then 1 and 3
    w, h, rgb = codecs.decode_gif(gif(3, 4, stored, 2, 1, palette, interlaced))
    want = np.zeros((5, 6, 3), int)
    want[1:5, 2:5] = palette[frame].astype(int) * 257
    assert (w, h) == (6, 5) and np.array_equal(rgb.reshape(5, 6, 3), want)


def test_lzw_with_growing_codes():
    text = bytes(RNG.integers(0, 4, 3000).astype(np.uint8))
    table, codes, word = {bytes([i]): i for i in range(4)}, [4], b""
    width, acc, have, out, nxt = 3, 0, 0, bytearray(), 6

    def put(code):
        nonlocal acc, have
        acc |= code << have
        have += width
        while have >= 8:
            out.append(acc & 255)
            acc >>= 8
            have -= 8

    put(4)
    for b in text:
        if word + bytes([b]) in table:
            word += bytes([b])
            continue
        put(table[word])
        if nxt < 4096:
            table[word + bytes([b])] = nxt
            nxt += 1
            if nxt > 1 << width and width < 12:
                width += 1
        word = bytes([b])
    put(table[word])
    put(5)
    out.append(acc & 255)
    assert codecs._lzw(bytes(out), 2, True, 0, len(text)) == text and codes


def tiff(order, fields, body):
    """fields: (tag, type, values); tag 273 points to body."""
    letters = {1: "B", 2: "s", 3: "H", 4: "I", 5: "I"}
    entries, rest, at = b"", b"", 8 + 2 + 12 * len(fields) + 4
    for tag, kind, values in sorted(fields):
        data = values if kind == 2 else b"".join(struct.pack(order + letters[kind], v) for v in values)
        n = len(values) // (2 if kind == 5 else 1)
        if len(data) > 4:
            entries += struct.pack(order + "HHII", tag, kind, n, at + len(rest))
            rest += data
        else:
            entries += struct.pack(order + "HHI", tag, kind, n) + data.ljust(4, b"\0")
    size = at + len(rest)
    if body:
        place = entries.index(struct.pack(order + "HHI", 273, 4, 1))
        entries = entries[: place + 8] + struct.pack(order + "I", size) + entries[place + 12 :]
    return (b"II\x2a\0" if order == "<" else b"MM\0\x2a") + struct.pack(order + "IH", 8, len(fields)) + entries + bytes(4) + rest + body


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize(("channels", "kind", "bits", "how"), [(1, 1, 8, 1), (2, 1, 8, 8), (3, 2, 16, 1), (4, 2, 8, 8), (3, 2, 32, 1), (4, 5, 16, 1)])
def test_tiff_layouts(order, channels, kind, bits, how):
    v = RNG.integers(0, 1 << bits, (4, 5, channels), dtype=np.uint64)
    raw = v.astype(f"{order}u{bits // 8}").tobytes()
    body = zlib.compress(raw) if how == 8 else raw
    fields = [(256, 3, [5]), (257, 4, [4]), (258, 3, [bits] * channels), (259, 3, [how]), (262, 3, [kind]), (273, 4, [0]), (277, 3, [channels]), (278, 3, [4]), (279, 4, [len(body)])]
    w, h, rgb = codecs.decode_tiff(tiff(order, fields, body))
    wide = v.astype(int) * 257 if bits == 8 else v.astype(int) >> (16 if bits == 32 else 0)
    if kind == 5:
        unit = 1 - wide / 65535
        want = (unit[:, :, :3] * unit[:, :, 3:] * 65535).astype(int)
    else:
        want = np.repeat(wide[:, :, :1], 3, axis=2) if channels < 3 else wide[:, :, :3]
    assert (w, h) == (5, 4) and np.array_equal(rgb.reshape(4, 5, 3), want)


def test_float_tiff_and_predictor():
    f = np.array([[-1.0, 0.5], [1.5, 0.25]], "<f4")
    base = [(256, 3, [2]), (257, 3, [2]), (259, 3, [1]), (262, 3, [1]), (273, 4, [0]), (277, 3, [1]), (278, 3, [2])]
    got = codecs.decode_tiff(tiff("<", [*base, (258, 3, [32]), (339, 3, [3]), (279, 4, [16])], f.tobytes()))[2]
    assert got[:, 0].tolist() == [0, 32767, 65535, 16383]
    got = codecs.decode_tiff(tiff("<", [*base, (258, 3, [8]), (317, 3, [2]), (279, 4, [4])], bytes([200, 100, 1, 2])))[2]
    assert (got[:, 0] // 257).tolist() == [200, 44, 1, 3]


def ljpeg(samples, precision, predictor, components=1, shift=0, restart=False):
    """Every category has a code of five bits, so the table is simple."""
    h, w = samples.shape
    bits = []

    def put(value, n):
        bits.extend((value >> (n - 1 - k)) & 1 for k in range(n))

    def difference(d):
        size = abs(d).bit_length()
        put(size, 5)
        if size:
            put(d if d > 0 else d + (1 << size) - 1, size)

    first = 1 << (precision - shift - 1)
    if components == 1:
        for y in range(h):
            for x in range(w):
                a, b = int(samples[y, x - 1]) if x else first, int(samples[y - 1, x]) if y else first
                guess = first if not x and not y else a if not y else b if not x else codecs.PREDICT[predictor](a, b, int(samples[y - 1, x - 1]))
                difference(int(samples[y, x]) - guess)
    else:
        above = [first] * 4
        for y in range(0, h, 2):
            now = list(above)
            for x in range(0, w, 2):
                cell = [int(samples[y + c // 2, x + c % 2]) for c in range(4)]
                for c in range(4):
                    difference(cell[c] - now[c])
                now = cell
                if not x:
                    above = cell
    bits += [1] * (-len(bits) % 8)
    scan = b"".join(bytes([v]) + (b"\0" if v == 0xFF else b"") for v in np.packbits(np.array(bits, np.uint8)).tolist())
    seg = lambda m, b: bytes([0xFF, m]) + struct.pack(">H", len(b) + 2) + b
    table = bytes([0, *[0] * 4, 17, *[0] * 11]) + bytes(range(17))
    ids = bytes(range(1, components + 1))
    sof = struct.pack(">BHHB", precision, h // (2 if components == 4 else 1), w // (2 if components == 4 else 1), components) + b"".join(bytes([i, 0x11, 0]) for i in ids)
    sos = bytes([components]) + b"".join(bytes([i, 0]) for i in ids) + bytes([predictor, 0, shift])
    return b"\xff\xd8" + (seg(0xDD, b"\0\x04") if restart else b"") + seg(0xFE, b"note") + seg(0xC4, table) + seg(0xC3, sof) + seg(0xDA, sos) + scan + b"\xff\xd9"


@pytest.mark.parametrize("predictor", range(1, 8))
def test_ljpeg_predictors(predictor):
    s = RNG.integers(0, 1 << 14, (6, 9))
    w, h, got = codecs.decode_ljpeg(ljpeg(s, 14, predictor, restart=True))
    assert (w, h) == (9, 6) and np.array_equal(got, s)


def test_ljpeg_cells_shift_and_errors():
    s = RNG.integers(0, 1 << 12, (6, 8))
    assert np.array_equal(codecs.decode_ljpeg(ljpeg(s, 12, 1, 4), 8, 6)[2], s)
    assert np.array_equal(codecs.decode_ljpeg(ljpeg(s, 14, 1, shift=2))[2], s << 2)
    for bad in (b"", b"\xff\xd8\xff\xd9", ljpeg(s, 12, 1).replace(b"\xff\xc3", b"\xff\xc1")):
        with pytest.raises(Unreadable):
            codecs.decode_ljpeg(bad)


def test_dng_round_trip_and_sniff(spark):
    rgb = RNG.integers(0, 65536, (20, 3))
    file = codecs.encode_dng(5, 4, rgb, "Maker", "Model")
    w, h, got = codecs.decode_linear_dng(file)
    assert (w, h) == (5, 4) and np.array_equal(got, rgb)
    make = lambda name: tiff("<", [(271, 2, name)], b"") + bytes(16)
    cases = [(file, "DNG"), (make(b"SONY corp\0"), "ARW"), (make(b"NIKON\0"), "NEF"), (make(b"other\0"), None), (b"II\x2a\0\xff\xff\xff\xff" + bytes(16), None), (b"II\x01\0\0\0HEAPCCDR" + bytes(8), "CRW")]
    t = spark.createDataFrame([(i, bytearray(c)) for i, (c, _) in enumerate(cases)], "file_id long, content binary")
    assert {r.file_id: r.raw_format for r in formats.sniff_raw(t).collect()} == {i: f for i, (_, f) in enumerate(cases)}


def test_tags_as_rows(spark):
    inner = struct.pack("<HHHIIHHIII", 2, 0x829A, 5, 1, 300, 0x8827, 3, 1, 640, 0)
    file = tiff("<", [(271, 2, b"Maker\0"), (0x8769, 4, [200]), (0x014A, 4, [200, 9999])], b"").ljust(200, b"\0") + inner
    file = file.ljust(300, b"\0") + struct.pack("<II", 1, 125)
    t = spark.createDataFrame([(1, bytearray(file)), (2, bytearray(b"no")), (3, None)], "file_id long, content binary")
    got = ifd.tags(t).collect()
    assert {(r.dir, r.tag, r.text, r.num, r.den) for r in got if r.file_id == 1} >= {("ifd0", 271, "Maker", None, None)}
    exposure = [r for r in got if r.tag == 0x829A]
    assert [(r.num, r.den, r.value) for r in exposure] == [(1, 125, 0.008)]  # a place is read once, though two tags point to it
    assert [r.error for r in got if r.file_id in (2, 3)] == ["not a TIFF header"] * 2


def test_opcodes():
    op = lambda kind, body, flags=0: struct.pack(">4I", kind, 1, flags, len(body)) + body
    gain = struct.pack(">8I6I4dI", 0, 1, 0, 1, 4, 1, 5, 0, 0, 3, 1, 1, 1, 2, 1.0, 1.0, 0.0, 0.0, 1) + struct.pack(">2f", 1.5, 0.5)
    ops = [op(4, struct.pack(">2I", 1, 99)), op(5, struct.pack(">2I2I4I", 1, 1, 7, 8, 1, 2, 3, 4), 1), op(9, gain), op(12, b"abc"), op(9, gain[:50])]
    got = codecs.opcodes(struct.pack(">I", 9) + b"".join(ops) + b"\0\0")
    assert [o["name"] for o in got] == ["fix_bad_pixels_constant", "fix_bad_pixels_list", "gain_map", "unknown"]
    assert got[0]["value"] == 99 and got[1]["points"] == [(7, 8)] and got[1]["rects"] == [(1, 2, 3, 4)] and got[1]["optional"]
    g = got[2]
    assert (g["rows"], g["cols"], g["gain"], g["bottom"], g["right"]) == (1, 2, [1.5, 0.5], 4.0, 1.0)
    assert codecs.opcodes(b"") == []


def test_decode_gives_rows_for_bad_files(spark):
    rgb = RNG.integers(0, 65536, (6, 3))
    cases = [codecs.encode_png(3, 2, rgb), codecs.encode_ppm(3, 2, rgb), codecs.encode_png(3, 2, rgb)[:40], b"RIFF....WEBPVP8 ", b"what is this", None]
    t = spark.createDataFrame([(i, c if c is None else bytearray(c)) for i, c in enumerate(cases)], "file_id long, content binary")
    got = {r.file_id: r for r in codecs.decode(t).collect()}
    assert got[0].data == got[1].data == rgb.ravel().tolist() and got[0].error is None
    assert all(got[i].error and got[i].data is None for i in range(2, 6))


def test_unpack():
    assert codecs.unpack_be16(b"\x01\x02\xff\xff\x07").tolist() == [258, 65535]


def test_image_source(spark, tmp_path):
    rgb = (RNG.integers(0, 256, (6, 3)) * 257).astype(int)
    (tmp_path / "a.png").write_bytes(codecs.encode_png(3, 2, rgb, 8))
    r = codecs.read_images(spark, str(tmp_path)).first()
    assert (r.width, r.height, r.data) == (3, 2, rgb.ravel().tolist())


def test_stream_of_files(spark, tmp_path):
    from framequarry.streaming.ingest import images, probe_images

    files, out = tmp_path / "in", tmp_path / "out"
    files.mkdir()
    for i in range(3):
        (files / f"{i}.png").write_bytes(codecs.encode_png(4, i + 1, np.zeros((4 * (i + 1), 3), int)))
    (files / "x.bin").write_bytes(b"nothing here")
    q = probe_images(images(spark, str(files), 2)).writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r.format or "", r.height) for r in spark.read.parquet(str(out)).collect()) == [("", None), ("PNG", 1), ("PNG", 2), ("PNG", 3)]


def test_ppm_comments_of_any_length(spark):
    note = b"# " + b"x" * 10_000 + b"\n"
    file = b"P6\n" + note + b"2 " + note + b"1\n" + note + b"65535\n" + bytes(range(12))
    assert codecs.decode_ppm(file)[:2] == (2, 1)
    rows = spark.createDataFrame([(1, bytearray(file)), (2, bytearray(b"P6 " + b" " * 20_000))], "file_id int, content binary")
    got = {r.file_id: (r.width, r.height, r.bit_depth) for r in formats.probe(rows).collect()}
    assert got == {1: (2, 1, 16), 2: (None, None, None)}


def test_unreadable_and_large_files_have_rows(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(codecs.encode_png(3, 2, np.zeros((6, 3), dtype=np.int32), 8))
    (tmp_path / "b.png").write_bytes(b"no image")
    got = {r.file_id[-5:]: (r.width, r.error is None) for r in codecs.read_images(spark, str(tmp_path)).collect()}
    assert got == {"a.png": (3, True), "b.png": (None, False)}
    stream = ingest.probe_images(ingest.images(spark, str(tmp_path), max_bytes=20))
    q = stream.writeStream.format("memory").queryName("probed").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r.path[-5:]: r.error for r in spark.table("probed").collect()}
    assert got == {"a.png": "too large to be read", "b.png": "unrecognized image format"}


@pytest.mark.parametrize("how", ["none", "sub", "up", "average", "paeth", "min_sum_abs", "brute_force"])
@pytest.mark.parametrize("bits", [8, 16])
def test_png_filters_and_levels(how, bits):
    rgb = np.random.default_rng(3).integers(0, 256, (5 * 7, 3)).astype(np.int32) * 257
    for level in codecs.LEVELS:
        assert (codecs.decode_png(codecs.encode_png(7, 5, rgb, bits, level, how))[2] == rgb).all()


def test_png_limits(spark):
    png = codecs.encode_png(7, 5, np.zeros((35, 3), np.int32))
    noted = embedded.with_png_blocks(png, exif=b"x" * 100)
    for limits, name in [(codecs.Limits(max_width=6), "width"), (codecs.Limits(max_height=4), "height"), (codecs.Limits(max_image_bytes=209), "image bytes"), (codecs.Limits(max_metadata_bytes=99), "metadata bytes")]:
        rows = codecs.decode(spark.createDataFrame([(0, bytearray(noted))], "file_id long, content binary"), limits).collect()
        assert rows[0].data is None and name in rows[0].error
    assert codecs.decode_png(noted, codecs.Limits(7, 5, 210, 100))[0] == 7


def test_runs():
    assert codecs.unpack_runs(bytes([2, 1, 2, 3, 254, 9, 128, 0, 7]), 7) == bytes([1, 2, 3, 9, 9, 9, 7])


@pytest.mark.parametrize("planar", [1, 2])
@pytest.mark.parametrize("tiled", [False, True])
@pytest.mark.parametrize("how", [1, 8, 32773])
def test_tiff_cells(planar, tiled, how):
    h, w = 5, 7
    x = np.random.default_rng(5).integers(0, 256, (h, w, 3)).astype(np.uint8)
    layers = [x[..., c : c + 1] for c in range(3)] if planar == 2 else [x]
    th, tw = (4, 4) if tiled else (2, w)
    cells = []
    for v in layers:
        for y in range(0, h, th):
            for left in range(0, w, tw):
                cell = np.zeros((th if tiled else min(th, h - y), tw, v.shape[2]), np.uint8)
                part = v[y : y + th, left : left + tw]
                cell[: part.shape[0], : part.shape[1]] = part
                cells.append(cell.tobytes())
    literal = lambda b: b"".join(bytes([len(b[i : i + 128]) - 1]) + b[i : i + 128] for i in range(0, len(b), 128))
    cells = [c if how == 1 else zlib.compress(c) if how == 8 else literal(c) for c in cells]
    places = {322: (3, [4]), 323: (3, [4]), 324: ("blobs", list(range(len(cells)))), 325: (4, [len(c) for c in cells])} if tiled else {278: (3, [2]), 273: ("blobs", list(range(len(cells)))), 279: (4, [len(c) for c in cells])}
    d = tree_file([{256: (3, [w]), 257: (3, [h]), 258: (3, [8, 8, 8]), 259: (3, [how]), 262: (3, [2]), 277: (3, [3]), 284: (3, [planar])} | places], "<", cells)
    assert (codecs.decode_tiff(d)[2] == x.reshape(-1, 3).astype(np.int32) * 257).all()


def java_jpeg(spark, pixels, progressive=False, every=None):
    """Written by the JVM; colour has halved chroma."""
    jvm = spark._jvm
    h, w = pixels.shape[:2]
    gray = pixels.ndim == 2
    img = jvm.java.awt.image.BufferedImage(w, h, 10 if gray else 1)
    raster = img.getRaster()
    for y in range(h):
        for x in range(w):
            for c, v in enumerate([pixels[y, x]] if gray else pixels[y, x]):
                raster.setSample(x, y, c, int(v))
    writer = jvm.javax.imageio.ImageIO.getImageWritersByFormatName("jpeg").next()
    param = writer.getDefaultWriteParam()
    if progressive:
        param.setProgressiveMode(1)
    out = jvm.java.io.ByteArrayOutputStream()
    writer.setOutput(jvm.javax.imageio.stream.MemoryCacheImageOutputStream(out))
    writer.write(None, jvm.javax.imageio.IIOImage(img, None, None), param)
    writer.getOutput().close()
    return bytes(out.toByteArray())


@pytest.mark.parametrize("progressive", [False, True])
@pytest.mark.parametrize("gray", [False, True])
def test_jpeg_as_the_jvm_reads_it(spark, tmp_path, progressive, gray):
    y, x = np.mgrid[:29, :37]
    pixels = np.stack([128 + 90 * np.sin(x / 5 + c) * np.cos(y / (4 + c)) for c in range(3)], axis=-1).astype(int)
    d = java_jpeg(spark, pixels[..., 0] if gray else pixels, progressive)
    assert (b"\xff\xc2" in d) == progressive
    (tmp_path / "a.jpg").write_bytes(d)
    want = codecs.read_images(spark, str(tmp_path)).first()
    got = codecs.decode(spark.createDataFrame([(1, bytearray(d)), (2, bytearray(d[:-60])), (3, bytearray(d[:40]))], "file_id long, content binary")).orderBy("file_id").collect()
    assert (got[0].format, got[0].width, got[0].height, got[0].error) == ("JPEG", 37, 29, None)
    off = np.abs(np.array(got[0].data) - np.array(want.data)) // 257
    assert off.max() <= 4 and off.mean() < 0.6, (off.max(), off.mean())
    assert all(r.data is None and r.error for r in got[1:])


def test_jpeg_inks_are_folded(spark):
    """A gray file's scan four times over is one of four equal inks."""
    d = java_jpeg(spark, np.full((8, 8), 100))
    one = codecs.DECODERS["JPEG"](d)[2][0, 0] // 257
    frame = d.index(b"\xff\xc0")
    scan = d.index(b"\xff\xda")
    n = int.from_bytes(d[scan + 2 : scan + 4])
    bits = d[scan + 2 + n : -2]
    table = d[frame + 12 : frame + 13]
    head = d[:frame] + b"\xff\xc0" + struct.pack(">HBHHB", 20, 8, 8, 8, 4) + b"".join(bytes([i, 0x11]) + table for i in (1, 2, 3, 4)) + d[frame + 13 : scan]
    four = head + b"".join(b"\xff\xda" + struct.pack(">HBBB", 8, 1, i, 0) + b"\0\x3f\0" + bits for i in (1, 2, 3, 4)) + b"\xff\xd9"
    p = one * one + 128
    assert set(codecs.DECODERS["JPEG"](four)[2].ravel().tolist()) == {(p + (p >> 8) >> 8) * 257}
