"""What a file is, and how large, from its first bytes.

Sniffers and most probes are column expressions over ``content``; only those that walk a file
(JPEG markers, TIFF entries, ``ispe`` boxes) run in Python, in Arrow batches, on the rows of their format.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..data.formats import CODECS, COLOR_DESCRIPTIONS, ENCODE_DEFAULTS, EXTENSIONS, FORMATS
from ..ship import ship

HEAD = 32


def head(content: Column) -> Column:
    return F.hex(F.substring(content, 1, HEAD))


def _hex(b: bytes) -> str:
    return b.hex().upper()


def _brand(h: Column, *brands: bytes) -> Column:
    return (h.substr(9, 8) == _hex(b"ftyp")) & h.substr(17, 8).isin(*map(_hex, brands))


def sniff_standard(content: Column) -> Column:
    """The format's name, or null; the order of tests counts. Less than 8 bytes are nothing.

    ``mif1`` is taken for AVIF. SVG needs ``<svg`` anywhere, after a start like XML. P1 to P4 are left out.
    """
    h, n = head(content), F.octet_length(content)
    starts = lambda *bs: F.concat(F.lit(""), h).rlike("^(" + "|".join(_hex(b) for b in bs) + ")")
    space = "(09|0A|0C|0D|20)"
    name = (
        F.when(starts(b"GIF87a", b"GIF89a"), "GIF")
        .when(starts(b"\xff\xd8\xff"), "JPEG")
        .when(starts(b"\x89PNG\r\n\x1a\n"), "PNG")
        .when((n >= 12) & starts(b"RIFF") & (h.substr(17, 8) == _hex(b"WEBP")), "WebP")
        .when(starts(b"\xff\x0a"), "JXL")
        .when((n >= 12) & (h.substr(9, 8) == _hex(b"JXL ")), "JXL")
        .when(starts(b"II\x2a\0", b"MM\0\x2a"), "TIFF")
        .when((n >= 12) & _brand(h, b"avif", b"avis", b"mif1"), "AVIF")
        .when((n >= 12) & _brand(h, b"heic", b"heis", b"hevc", b"hevx"), "HEIC")
        .when((n >= 12) & _brand(h, b"apv1", b"apvx"), "APV")
        .when(h.rlike(f"^50(35|36|37|46|66){space}"), "PPM")
        .when(starts(b"<?xm", b"<svg", b"<!--"), F.when(F.contains(content, F.lit(b"<svg")), "SVG"))
    )
    return F.when(n >= 8, name)


def matches(content: Column, name: str) -> Column:
    """The laxer test of a single format: any ``<svg`` makes SVG, the others ask for their first bytes alone."""
    h = head(content)
    if name == "SVG":
        return F.contains(content, F.lit(b"<svg"))
    if name == "PPM":
        return h.rlike("^50(35|36|37|46|66)(09|0A|0C|0D|20)")
    first = {"GIF": "474946383[79]61", "JPEG": "FFD8FF", "PNG": "89504E470D0A1A0A", "WebP": "52494646.{8}57454250", "JXL": "(FF0A|.{8}4A584C20)", "TIFF": "(49492A00|4D4D002A)"}
    return h.rlike("^" + first[name])


def sniff_raw_head(content: Column) -> Column:
    """RAF, CR3, CRW or CR2 from 16 bytes; ``TIFF`` where the first directory must decide; null if none."""
    h = head(content)
    tiff = h.rlike("^(49492A00|4D4D002A)")
    crw = h.rlike("^(49490100|4D4D0001)") & (h.substr(13, 16) == _hex(b"HEAPCCDR"))
    return (
        F.when(F.octet_length(content) < 16, None)
        .when(h.substr(1, 32) == _hex(b"FUJIFILMCCD-RAW "), "RAF")
        .when(_brand(h, b"crx ", b"crx2"), "CR3")
        .when(crw, "CRW")
        .when(tiff & (h.substr(17, 6) == _hex(b"CR\x02")), "CR2")
        .when(tiff, "TIFF")
    )


def _by_directory(data: bytes | None) -> str | None:
    from .ifd import first_directory

    d = first_directory(data)
    if d is None:
        return None
    if 0xC612 in d:
        return "DNG"
    make = d.get(0x010F)
    make = make.lower() if isinstance(make, str) else ""
    return "ARW" if "sony" in make else "NEF" if "nikon" in make else None


def sniff_raw(files: DataFrame, out: str = "raw_format") -> DataFrame:
    """RAF, CR3, CRW, CR2, DNG, ARW, NEF or null. A DNG version beats the maker's name."""
    ship(files.sparkSession)

    @F.pandas_udf("string")
    def by_directory(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield s.map(_by_directory, na_action="ignore").astype(object)

    kind = sniff_raw_head(F.col("content"))
    return files.withColumn(out, F.when(kind == "TIFF", by_directory(F.when(kind == "TIFF", F.col("content")))).otherwise(kind))


def _int(h: Column, at: int, size: int, little: bool = False) -> Column:
    """An unsigned number at a byte place of the hexadecimal head."""
    digits = F.concat(*[h.substr(2 * (at + i) + 1, 2) for i in (reversed(range(size)) if little else range(size))])
    return F.conv(digits, 16, 10).cast("long")


def jpeg_size(d: bytes) -> tuple[int, int, int | None] | None:
    """Of the first frame marker; other segments are stepped over by their lengths."""
    at, n = 2, len(d)
    while at + 1 < n:
        m = d[at + 1]
        if d[at] != 0xFF or m == 0xFF:
            at += 1
        elif m in (0, 1) or 0xD0 <= m <= 0xD9:
            at += 2
        elif 0xC0 <= m <= 0xCF and m not in (0xC4, 0xC8, 0xCC):
            return (int.from_bytes(d[at + 7 : at + 9]), int.from_bytes(d[at + 5 : at + 7]), d[at + 4]) if at + 9 <= n else None
        elif at + 4 > n:
            return None
        else:
            at += 2 + max(2, int.from_bytes(d[at + 2 : at + 4]))
    return None


def tiff_size(d: bytes) -> tuple[int, int, None] | None:
    order = {b"II": "little", b"MM": "big"}.get(d[:2])
    if order is None or len(d) < 8:
        return None
    num = lambda at, size: int.from_bytes(d[at : at + size], order)
    at = num(4, 4)
    if at + 2 > len(d):
        return None
    found: dict[int, int] = {}
    for e in range(at + 2, at + 2 + 12 * num(at, 2), 12):
        if e + 12 > len(d):
            break
        size = {3: 2, 4: 4}.get(num(e + 2, 2))
        if size and num(e, 2) in (0x100, 0x101):
            found[num(e, 2)] = num(e + 8, size)
    return (found[0x100], found[0x101], None) if len(found) == 2 else None


def ispe_size(d: bytes) -> tuple[int, int, None] | None:
    """The largest area of all ``ispe`` boxes; the first of equal ones."""
    best, at = None, d.find(b"ispe")
    while at >= 0:
        if at + 16 <= len(d):
            w, h = int.from_bytes(d[at + 8 : at + 12]), int.from_bytes(d[at + 12 : at + 16])
            if best is None or w * h > best[0] * best[1]:
                best = (w, h, None)
        at = d.find(b"ispe", at + 1)
    return best


def ppm_words(d: bytes, n: int = 3) -> tuple[list[bytes], int]:
    """The first n words after the kind, wherever comments and white space end, and the place behind the last."""
    import re

    word, words, at = re.compile(rb"(?:\s++|#[^\n]*+)*+([^\s#]+)"), [], 2
    while len(words) < n and (m := word.match(d, at)):
        words.append(m[1])
        at = m.end()
    return words, at


def ppm_size(d: bytes) -> tuple[int, int, int | None] | None:
    numbers = [int(w) if w.isdigit() and len(w) < 11 and int(w) < 1 << 32 else None for w in ppm_words(d)[0]]
    if len(numbers) < 2 or None in numbers[:2]:
        return None
    top = numbers[2] if len(numbers) > 2 else None
    return numbers[0], numbers[1], None if top is None else 16 if top > 255 else 8


WALKED = {"JPEG": jpeg_size, "TIFF": tiff_size, "AVIF": ispe_size, "HEIC": ispe_size, "PPM": ppm_size}
PROBE = "width bigint, height bigint, bit_depth int"


def probe(files: DataFrame) -> DataFrame:
    """Adds format, width, height, bit_depth, color and error; the pixels are never decoded."""
    ship(files.sparkSession)

    @F.pandas_udf(PROBE)
    def walk(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for formats, contents in parts:
            got = [WALKED[f](bytes(c)) if f in WALKED and c is not None else None for f, c in zip(formats, contents, strict=True)]
            yield pd.DataFrame([g or (None, None, None) for g in got], columns=["width", "height", "bit_depth"]).astype("Int64")

    f, h, n = F.col("format"), head(F.col("content")), F.octet_length("content")
    walked = f.isin(*WALKED)
    q = files.withColumn("format", sniff_standard(F.col("content")))
    q = q.withColumn("_w", walk(F.when(walked, f), F.when(walked, F.col("content"))))

    def size(w: Column, hh: Column, bits: Column) -> Column:
        return F.struct(w.alias("width"), hh.alias("height"), bits.cast("int").alias("bit_depth"))

    none = F.lit(None).cast("struct<width:bigint,height:bigint,bit_depth:int>")
    chunk, low14 = h.substr(25, 8), F.lit(0x3FFF).cast("long")
    bits = _int(h, 21, 4, True)
    webp = (
        F.when(n < 30, none)
        .when(chunk == _hex(b"VP8X"), size(_int(h, 24, 3, True) + 1, _int(h, 27, 3, True) + 1, F.lit(8)))
        .when(chunk == _hex(b"VP8 "), size(_int(h, 26, 2, True).bitwiseAND(low14), _int(h, 28, 2, True).bitwiseAND(low14), F.lit(8)))
        .when(chunk == _hex(b"VP8L"), size(bits.bitwiseAND(low14) + 1, F.shiftright(bits, 14).bitwiseAND(low14) + 1, F.lit(8)))
    )
    found = (
        F.when(f == "PNG", F.when((n >= 26) & (h.substr(25, 8) == _hex(b"IHDR")), size(_int(h, 16, 4), _int(h, 20, 4), _int(h, 24, 1))))
        .when(f == "GIF", F.when(n >= 10, size(_int(h, 6, 2, True), _int(h, 8, 2, True), F.lit(8))))
        .when(f == "WebP", webp)
        .when(walked & F.col("_w.width").isNotNull(), F.col("_w"))
    )
    q = q.withColumn("_p", found)
    error = F.when(f.isNull(), "unrecognized image format").when(F.col("_p").isNull(), F.concat(F.lit("no size found in "), f))
    return q.select(*files.columns, "format", "_p.width", "_p.height", "_p.bit_depth", F.when(F.col("_p").isNotNull(), "sRGB").alias("color"), error.alias("error"))


def formats(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(FORMATS, "name string, extension string, mime string, decode boolean, encode boolean")


def by_extension(df: DataFrame, ext: str) -> DataFrame:
    """Adds ``format`` by an extension, whatever its case; unknown ones have null."""
    t = df.sparkSession.createDataFrame(list(EXTENSIONS.items()), "_ext string, format string")
    return df.join(F.broadcast(t), F.lower(df[ext]) == F.col("_ext"), "left").drop("_ext")


def codecs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CODECS, "id string, direction string")


def encode_defaults(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ENCODE_DEFAULTS, "format string, option string, value string")


def color_descriptions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(COLOR_DESCRIPTIONS, "name string, primaries int, transfer int")


def color_name(df: DataFrame, primaries: str, transfer: str, out: str = "color") -> DataFrame:
    """The name of a pair of code points; ``CICP`` for pairs without one."""
    c = color_descriptions(df.sparkSession).toDF(out, "_p", "_t")
    named = df.join(F.broadcast(c), (df[primaries] == F.col("_p")) & (df[transfer] == F.col("_t")), "left").drop("_p", "_t")
    return named.withColumn(out, F.coalesce(out, F.lit("CICP")))
