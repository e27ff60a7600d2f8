"""RAW containers and embedded metadata, from files built here."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from framequarry.operators import codecs, embedded, isobmff, planes, raw
from framequarry.plans.develop import Options, develop
from framequarry.plans.develop_frames import develop_frames
from framequarry.plans.export import export, save
from tests.files import box, tiff
from tests.test_codecs import ljpeg

RNG = np.random.default_rng(11)
W, H = 12, 8
MOSAIC = RNG.integers(600, 15000, (H, W))


def sony(order="<"):
    tiles = [ljpeg(np.pad(MOSAIC, ((0, 0), (0, 4)), mode="edge")[:, x : x + 8], 14, 1) for x in (0, 8)]
    sub = {256: (4, [W]), 257: (4, [H]), 258: (3, [14]), 259: (3, [7]), 262: (3, [32803]), 0x828E: (1, [1, 0, 2, 1]), 322: (3, [8]), 323: (3, [8]), 324: ("blobs", [0, 1]), 325: (4, [len(t) for t in tiles]), 0x7313: (8, [2000, 1000, 1000, 1600]), 0xC61D: (3, [16000]), 0xC61F: (4, [2, 1]), 0xC620: (4, [8, 6])}
    small = {256: (4, [3]), 257: (4, [3]), 262: (3, [32803])}
    exif = {0x829A: (5, [1, 125]), 0x8827: (3, [200]), 0xA434: (2, b"Lens 35\0"), 0x9011: (2, b"+02:00\0"), 0x9010: (2, b"+01:00\0")}
    return tiff([{271: (2, b"SONY\0"), 272: (2, b"ILCE-6700\0"), 274: (3, [6]), 0x014A: [small, sub], 0x8769: [exif], 0x0201: ("blob", 2), 0x0202: (4, [5])}], order, [*tiles, b"thumb"])


def nikon(how=1):
    body = MOSAIC.astype("<u2").tobytes() if how == 1 else ljpeg(MOSAIC, 14, 1)
    sub = {256: (4, [W]), 257: (4, [H]), 258: (3, [14]), 259: (3, [how]), 273: ("blob", 0), 279: (4, [len(body)]), 0x828E: (1, [2, 1, 1, 0])}
    return tiff([{271: (2, b"NIKON CORPORATION\0"), 272: (2, b"Nikon Z 6\0"), 0x014A: [sub]}], ">" if how != 1 else "<", [body])


def canon():
    body = ljpeg(MOSAIC, 14, 1)
    plain = {256: (3, [2]), 257: (3, [2])}
    data = {256: (3, [W]), 257: (3, [H]), 258: (3, [14]), 259: (3, [6]), 273: ("blob", 0), 279: (4, [len(body)])}
    return tiff([{271: (2, b"Canon\0"), 272: (2, b"Canon EOS R5\0")}, plain, plain, data], "<", [body], b"CR\x02\0\0\0\0\0")


def fuji(model=b"X-T5"):
    exif = tiff([{256: (4, [W]), 257: (4, [H])}])
    jpeg = b"\xff\xd8\xff\xe1" + struct.pack(">H", len(exif) + 8) + b"Exif\0\0" + exif
    body = bytes(32) + MOSAIC.astype(">u2").tobytes()
    head = bytearray(160)
    head[:16], head[28 : 28 + len(model)] = raw.RAF_MAGIC, model
    for at, v in ((84, 160), (88, len(jpeg)), (92, 160 + len(jpeg)), (100, len(body))):
        head[at : at + 4] = struct.pack(">I", v)
    return bytes(head) + jpeg + body


def adobe():
    table = [min(65535, 4 * i) for i in range(16384)]
    top = {256: (4, [W]), 257: (4, [H]), 258: (3, [16]), 259: (3, [1]), 262: (3, [32803]), 271: (2, b"Apple\0"), 272: (2, b"iPhone 16 Pro\0"), 273: ("blob", 0), 279: (4, [W * H * 2]), 277: (3, [1]), 0x828E: (1, [0, 1, 1, 2]), 0xC612: (1, [1, 4, 0, 0]), 0xC618: (3, table), 0xC61A: (5, [512, 1, 1041, 2]), 0xC61D: (4, [65535]), 0xC621: (10, [x for i in range(9) for x in (int(i % 4 == 0), 1)]), 0xC628: (5, [1, 2, 1, 1, 3, 5]), 0xC62A: (10, [-83, 100]), 0xC68D: (4, [1, 3, 7, 11])}
    return tiff([top], "<", [MOSAIC.astype("<u2").tobytes()])


def canon3():
    cmt = tiff([{271: (2, b"Canon\0"), 272: (2, b"EOS R3\0"), 0x828E: (1, [1, 2, 0, 1])}])
    entry = struct.pack(">I4s", 60, b"CRAW") + bytes(24) + struct.pack(">HH", 600, 400) + bytes(24)
    trak = lambda n: box(b"trak", box(b"mdia", box(b"minf", box(b"stbl", box(b"stsd", struct.pack(">II", 0, 1) + entry) + box(b"stsz", struct.pack(">IIII", 0, 0, 2, n) + struct.pack(">I", n)) + box(b"stco", struct.pack(">III", 0, 1, 999))))))
    return box(b"ftyp", b"crx \0\0\0\0") + box(b"moov", box(b"uuid", isobmff.CANON + box(b"CMT1", cmt)) + trak(5) + trak(50))


def files(spark, *contents):
    return spark.createDataFrame([(i, c if c is None else bytearray(c)) for i, c in enumerate(contents)], "file_id long, content binary")


def test_frames_of_all_makers(spark):
    cases = [sony(), sony(">"), nikon(), nikon(6), canon(), fuji(), adobe(), canon3(), b"II\x01\0\0\0HEAPCCDR" + bytes(20), b"nothing at all here", None, sony()[:300]]
    got = {r.img_id: r for r in raw.read(files(spark, *cases)).collect()}
    assert [got[i].format for i in range(9)] == ["ARW", "ARW", "NEF", "NEF", "CR2", "RAF", "DNG", "CR3", "CRW"]
    for i in range(6):
        assert got[i].error is None and got[i].data == MOSAIC.ravel().tolist(), (i, got[i].error)
    for i in (0, 1):
        r = got[i]
        assert (r.cfa, r.area, r.black, r.white, r.orientation) == ("GRBG", [2, 1, 8, 6], [512] * 4, 16000, 6)
        assert r.neutral == [0.5, 1.0, 0.625]
    assert (got[2].cfa, got[2].black) == ("BGGR", [327] * 4)
    assert got[5].xtrans and (got[5].make, got[5].model, got[5].black) == ("FUJIFILM", "X-T5", [512] * 4)
    d = got[6]
    assert d.data == np.minimum(65535, MOSAIC * 4).ravel().tolist() and (d.bit_depth, d.black, d.area) == (16, [512, 521, 512, 521], [3, 1, 8, 6])
    assert d.neutral == [0.5, 1.0, 0.6] and d.exposure == -0.83 and d.matrix1 == [1.0, 0, 0, 0, 1, 0, 0, 0, 1]
    assert all(got[i].error and got[i].data is None for i in range(7, 12))


def test_metadata_and_thumbnails(spark):
    got = {r.img_id: r for r in raw.metadata(files(spark, sony(), canon3(), b"II\x01\0\0\0HEAPCCDR" + bytes(20), fuji(b"GFX 50"))).collect()}
    assert bytes(got[0].thumbnail) == b"thumb"
    assert (got[1].make, got[1].model, got[1].cfa, got[1].width, got[1].height) == ("Canon", "EOS R3", "GBRG", 600, 400)
    assert (got[2].width, got[2].height, got[2].white) == (*raw.CRW_SIZE, 4095)
    assert not got[3].xtrans and bytes(got[3].thumbnail)[:2] == b"\xff\xd8"


def test_a_bad_tile_stays_black(spark):
    d = bytearray(sony())
    at = d.rindex(b"\xff\xd8")
    d[at : at + 2] = b"\0\0"
    r = raw.read(files(spark, bytes(d))).first()
    data = np.array(r.data).reshape(H, W)
    assert r.error is None and not data[:, 8:].any() and np.array_equal(data[:, :8], MOSAIC[:, :8])


def test_active_area_keeps_the_layout(spark):
    r = raw.active(raw.read(files(spark, sony()))).first()
    assert (r.width, r.height) == (8, 6) and r.data == MOSAIC[1:7, 2:10].ravel().tolist()
    assert r.cfa == "BGGR"  # GRBG from its second row on


def test_development_of_a_file(spark):
    f = raw.read(files(spark, sony(), nikon())).withColumns({"camera": F.lit(5), "exposure": F.lit(0.0), "orientation": F.coalesce("orientation", F.lit(1)), "neutral": F.coalesce("neutral", F.array(F.lit(1.0), F.lit(1.0), F.lit(1.0)))})
    assert develop(f, Options(demosaic="bilinear")).count() == 2 * W * H


def test_capture_of_raw_files(spark):
    shot = {0x9003: (2, b"2025:01:02 03:04:05\0"), 0x9010: (2, b"+01:00\0"), 0x9011: (2, b"+02:00\0"), 0x8827: (3, [400]), 0x829A: (5, [1, 125]), 0xA434: (2, b"35mm F2\0")}
    place = {1: (2, b"N\0"), 2: (5, [43, 1, 39, 1, 0, 1])}
    d = tiff([{271: (2, b"Apple\0"), 272: (2, b"x\0"), 256: (4, [2]), 257: (4, [2]), 258: (3, [16]), 262: (3, [32803]), 0xC612: (1, [1, 4, 0, 0]), 0x8769: [shot], 0x8825: [place]}])
    e = raw.metadata(files(spark, d, fuji())).orderBy("img_id").collect()
    assert e[1].exif is None
    e = e[0].exif
    assert (e.datetime_original, e.offset_time, e.iso, e.lens_model, e.gps_latitude_ref) == ("2025:01:02 03:04:05", "+02:00", 400, "35mm F2", "N")
    assert (e.exposure_time.num, e.exposure_time.den) == (1, 125) and [x.num for x in e.gps_latitude] == [43, 39, 0] and e.flash is None


def linear_dng(samples, h, w, more=(), **cells):
    top = {256: (4, [w]), 257: (4, [h]), 258: (3, [16] * samples.shape[-1]), 259: (3, [1]), 262: (3, [34892 if samples.shape[-1] == 3 else 32803]), 271: (2, b"Apple\0"), 272: (2, b"x\0"), 277: (3, [samples.shape[-1]]), 0xC612: (1, [1, 4, 0, 0])}
    return top | dict(more) | cells


def tiles_of(samples, th, tw):
    h, w, c = samples.shape
    padded = np.zeros((-(-h // th) * th, -(-w // tw) * tw, c), samples.dtype)
    padded[:h, :w] = samples
    return [padded[y : y + th, x : x + tw] for y in range(0, h, th) for x in range(0, w, tw)]


def test_linear_dng_is_cut_and_corrected(spark):
    x = np.arange(6 * 8 * 3).reshape(6, 8, 3) * 100
    gain = struct.pack(">8I", 0, 1, 0, 1, 6, 1, 8, 1)
    body = gain + struct.pack(">6I", 0, 3, 1, 1, 1, 2) + struct.pack(">4d", 1.0, 1.0, 0.0, 0.0) + struct.pack(">I2f", 1, 1.0, 2.0)
    listed = struct.pack(">I4I", 1, 9, 0, 0, len(body)) + body
    blobs = [t.astype("<u2").tobytes() for t in tiles_of(x, 4, 4)]
    more = {322: (4, [4]), 323: (4, [4]), 324: ("blobs", list(range(len(blobs)))), 325: (4, [len(b) for b in blobs]), 0xC68D: (4, [1, 2, 5, 7])}
    plain, corrected, beyond = (tiff([linear_dng(x, 6, 8, more | extra)], "<", blobs) for extra in ({}, {0xC741: (7, listed)}, {0xC68D: (4, [0, 0, 7, 9])}))
    got = {r.img_id: r for r in raw.read(files(spark, plain, corrected, beyond)).collect()}
    cut = x[1:5, 2:7]
    assert (got[0].width, got[0].height, got[0].error) == (5, 4, None) and got[0].data == cut.ravel().tolist()
    want = (cut * np.linspace(1, 2, 5)[None, :, None]).clip(0, 65535)
    assert np.abs(np.array(got[1].data).reshape(4, 5, 3) - want).max() <= 1 and got[1].data[:3] == cut[0, 0].tolist()
    wide = np.array(got[2].data).reshape(7, 9, 3)
    assert (wide[:6, :8] == x).all() and not wide[6].any() and not wide[:, 8].any()


def test_packed_dng_samples(spark):
    x = np.arange(5 * 7).reshape(5, 7, 1) * 29 % 4096
    bits = (x.reshape(5, 7)[:, :, None] >> np.arange(11, -1, -1) & 1).reshape(5, -1).astype(np.uint8)
    body = np.packbits(bits, axis=1).tobytes()
    d = tiff([linear_dng(x, 5, 7, {258: (3, [12]), 273: ("blob", 0), 279: (4, [len(body)])})], "<", [body])
    r = raw.read(files(spark, d, d[:-9])).orderBy("img_id").collect()
    assert r[0].data == x.ravel().tolist() and r[0].white == 4095 and r[1].error and r[1].data is None


def test_export(spark, tmp_path):
    f = raw.read(files(spark, sony())).drop("img_id").withColumns({"img_id": F.lit("a/1"), "camera": F.lit(5), "exposure": F.lit(0.0), "neutral": F.array(F.lit(1.0), F.lit(1.0), F.lit(1.0))})
    f = f.unionByName(f.withColumns({"img_id": F.lit("b"), "data": F.array(F.lit(1))}))
    out = export(f, Options(demosaic="bilinear"), level="best", filter="min_sum_abs").orderBy("img_id").collect()
    pixels = develop_frames(f, Options(demosaic="bilinear")).where("img_id = 'a/1'").first()
    assert out[1].content is None and out[1].error == "samples do not fill the frame"
    w, h, rgb = codecs.decode_png(bytes(out[0].content))
    assert (w, h) == (pixels.width, pixels.height) and rgb.ravel().tolist() == pixels.data
    e = embedded.read(files(spark, bytes(out[0].content))).first()
    assert (e.make, e.orientation) == ("SONY", 1) and embedded.valid_profile(bytes(e.icc))
    rows = {r.img_id: r for r in save(export(f, Options(demosaic="bilinear"), kind="ppm"), f"file://{tmp_path}/out", "ppm").collect()}
    assert rows["b"].path is None and rows["b"].error
    assert codecs.decode_ppm((tmp_path / "out" / "a%2F1.ppm").read_bytes())[2].ravel().tolist() == pixels.data and len(list((tmp_path / "out").iterdir())) == 1


def test_embedded_records(spark):
    exif = embedded.build_exif({"make": "m", "model": "long model name", "orientation": 3, "iso": 70000, "exposure_time": {"num": 1, "den": 125}, "brightness_value": {"num": -7, "den": 2}, "datetime_original": "2025:01:15 10:30:00", "gps_latitude_ref": "N", "gps_latitude": [{"num": 43, "den": 1}, {"num": 39, "den": 1}, {"num": 0, "den": 1}], "gps_altitude_ref": 1, "gps_altitude": {"num": 76, "den": 1}})
    icc, xmp = embedded.srgb_profile(), b"<x:xmpmeta/>"
    png = embedded.with_png_blocks(codecs.encode_png(2, 2, np.zeros((4, 3), int)), exif, icc, xmp)
    seg = lambda m, b: bytes([0xFF, m]) + struct.pack(">H", len(b) + 2) + b
    jpeg = b"\xff\xd8" + seg(0xE1, b"Exif\0\0" + exif) + seg(0xE2, b"ICC_PROFILE\0\x01\x02" + icc[:200]) + seg(0xE2, b"ICC_PROFILE\0\x02\x02" + icc[200:]) + seg(0xE1, b"http://ns.adobe.com/xap/1.0/\0" + xmp) + b"\xff\xda"
    chunk = lambda k, b: k + struct.pack("<I", len(b)) + b + b"\0" * (len(b) % 2)
    body = b"WEBP" + chunk(b"VP8X", bytes(10)) + chunk(b"ICCP", icc) + chunk(b"EXIF", exif) + chunk(b"XMP ", xmp)
    webp = b"RIFF" + struct.pack("<I", len(body)) + body
    got = {r.file_id: r for r in embedded.read(files(spark, png, jpeg, webp, exif, b"\xff\xd8\xff\xe1\0\x08Exif", None)).collect()}
    for i in range(4):
        r = got[i]
        assert (r.make, r.model, r.orientation, r.iso, r.datetime_original) == ("m", "long model name", 3, 70000, "2025:01:15 10:30:00")
        assert (r.exposure_time.num, r.exposure_time.den, r.brightness_value.num) == (1, 125, -7)
        assert [x.num for x in r.gps_latitude] == [43, 39, 0] and (r.gps_latitude_ref, r.gps_altitude_ref, r.gps_altitude.num) == ("N", 1, 76)
        assert {(e.namespace, e.tag): e.value for e in r.extra}["exif", "0x829a"] == "1/125"
        if i < 3:
            assert bytes(r.icc) == icc and bytes(r.xmp) == xmp
    assert got[4].make is None and got[5].format is None
    assert embedded.valid_profile(icc) and not embedded.valid_profile(icc[:100]) and not embedded.valid_profile(None)


def test_profile_is_well_formed():
    icc = embedded.srgb_profile()
    n = int.from_bytes(icc[128:132])
    tags = {icc[132 + 12 * i : 136 + 12 * i]: struct.unpack_from(">II", icc, 136 + 12 * i) for i in range(n)}
    assert set(tags) == {b"desc", b"wtpt", b"rXYZ", b"gXYZ", b"bXYZ", b"rTRC", b"gTRC", b"bTRC"}
    assert all(a + s <= len(icc) for a, s in tags.values())
    at = tags[b"rTRC"][0]
    assert icc[at : at + 4] == b"curv" and icc[at + 12 : at + 14] == b"\x02\x38"


def heif(brand=b"heic"):
    full = lambda k, v, b: box(k, struct.pack(">I", v << 24) + b)
    exif = bytes(4) + embedded.build_exif({"make": "phone"})
    xmp = b"<x/>"
    infe = lambda i, t, rest=b"": full(b"infe", 2, struct.pack(">HH4s", i, 0, t) + b"\0" + rest)
    iinf = full(b"iinf", 0, struct.pack(">H", 6) + infe(1, b"hvc1") + infe(2, b"hvc1") + infe(3, b"hvc1") + infe(4, b"hvc1") + infe(5, b"Exif") + infe(6, b"mime", b"application/rdf+xml\0"))
    iref = full(b"iref", 0, box(b"auxl", struct.pack(">HHH", 3, 1, 1)) + box(b"auxl", struct.pack(">HHH", 4, 1, 1)) + box(b"thmb", struct.pack(">HHH", 2, 1, 1)))
    ispe = lambda w, h: full(b"ispe", 0, struct.pack(">II", w, h))
    aux = lambda s: full(b"auxC", 0, s + b"\0")
    ipco = box(b"ipco", ispe(640, 480) + ispe(64, 48) + aux(b"urn:com:apple:photo:2020:aux:hdrgainmap") + aux(isobmff.DEPTH_TYPES[0].encode()) + full(b"pixi", 0, b"\x03\x0a\x0a\x0a"))
    ipma = full(b"ipma", 0, struct.pack(">I", 4) + b"\0\1\2\1\5" + b"\0\2\1\2" + b"\0\3\2\2\3" + b"\0\4\2\2\4")
    pitm = full(b"pitm", 0, b"\0\1")
    idat = box(b"idat", exif + xmp)
    iloc = full(b"iloc", 1, b"\x44\0" + struct.pack(">H", 2) + struct.pack(">HHHHII", 5, 1, 0, 1, 0, len(exif)) + struct.pack(">HHHHII", 6, 1, 0, 1, len(exif), len(xmp)))
    meta = full(b"meta", 0, pitm + iinf + iref + box(b"iprp", ipco + ipma) + iloc + idat)
    return box(b"ftyp", brand + bytes(8)) + meta


def test_heif_items(spark):
    t = files(spark, heif(), heif(b"avif"), b"\0\0\0\x18ftypheic" + bytes(12), b"")
    r = {r.file_id: r for r in embedded.read(t).collect()}
    assert [r[i].format for i in range(3)] == ["HEIC", "AVIF", "HEIC"]
    assert (r[0].make, bytes(r[0].xmp), r[0].bit_depth) == ("phone", b"<x/>", 10) and r[2].make is None
    got = [(x.kind, x.item_id, x.width, x.height) for x in embedded.auxiliaries(t).where("file_id = 0").collect()]
    assert got == [("Thumbnail", 2, 64, 48), ("GainMap", 3, 64, 48), ("DepthMap", 4, 64, 48)]
    assert isobmff.classify_aux("x:disparity") == "DepthMap" and isobmff.classify_aux(None) == "Auxiliary"


@pytest.mark.parametrize("bad", [b"", b"\0\0\0\x04free", box(b"meta", b"\0\0\0\0" + box(b"iloc", b"\1\0\0\0"))])
def test_broken_boxes_give_nothing(spark, bad):
    assert embedded.auxiliaries(files(spark, bad)).count() == 0


def test_planes():
    y = bytes([1, 2, 3, 99, 4, 5, 6])
    assert planes.read_plane(y, 4, 3, 2)[0].tolist() == [1, 2, 3, 4, 5, 6]
    cb, cr = planes.read_plane(bytes([1, 2, 3, 4]), 4, 2, 1, channels=2)
    assert (cb.tolist(), cr.tolist()) == ([1, 3], [2, 4])
    p010 = struct.pack("<4H", 0x0040, 0xFFC0, 0x8000, 7)
    assert [x.tolist() for x in planes.read_plane(p010, 8, 2, 1, 2, 6, 10, 2)] == [[1, 512], [1023, 0]]
    with pytest.raises(ValueError):
        planes.read_plane(y, 4, 4, 2)
    ok = [(8, 64), (8, 32)]
    assert planes.frame_error(8, 8, 8, "NV12", ok) is None
    assert all(planes.frame_error(*a) for a in ((0, 8, 8, "NV12", ok), (8, 8, 10, "NV12", ok), (8, 8, 8, "I420", ok), (8, 8, 8, "NV12", [(7, 64), (8, 32)]), (8, 8, 8, "NV12", [(8, 64), (8, 31)]), (8, 8, 8, "XX", ok)))


def test_cmyk_fold(spark):
    t = spark.createDataFrame([(v, k) for v in range(0, 256, 5) for k in range(0, 256, 5)], "v int, k int")
    assert t.where(planes.cmyk_to_rgb8(F.col("v"), F.col("k")) != F.round(F.col("v") * F.col("k") / 255)).count() == 0


def test_png_text_is_checked():
    png = embedded.with_png_blocks(codecs.encode_png(1, 1, np.zeros((1, 3), int)), xmp=b"x")
    at = png.index(b"iTXt")
    n = int.from_bytes(png[at - 4 : at])
    assert int.from_bytes(png[at + 4 + n : at + 8 + n]) == zlib.crc32(png[at : at + 4 + n])
