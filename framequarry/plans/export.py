"""Developed frames as files: development, encoding with metadata, and one file a row in a folder."""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import codecs, embedded
from .develop import Options
from .develop_frames import develop_frames


def export(frames: DataFrame, options: Options = Options(), kind: str = "png", bits: int = 16, **encoding) -> DataFrame:
    """img_id, content, error of frames as ``develop_frames`` takes them; narrow, without a shuffle, by one Python process a task.

    With PNG, the columns make, model and orientation and the struct ``exif`` (as ``raw.metadata`` gives it) become the
    file's EXIF, where there are any, beside an sRGB profile. Pixels are upright, so an orientation is written as 1.
    A frame that cannot be developed or written has a row with its error.
    """
    kinds = dict(frames.dtypes)
    fields = [F.col(c) for c in ("make", "model") if c in kinds]
    if "orientation" in kinds:
        fields.append(F.when(F.col("orientation").isNotNull(), F.lit(1)).alias("orientation"))
    if "exif" in kinds:
        fields += [F.col(f"exif.{n}") for n in frames.schema["exif"].dataType.names]
    noted = kind == "png" and bool(fields)
    write = codecs.encoder(kind, bits, ["icc", "notes"] if noted else [], True, encoding)
    profile = embedded.srgb_profile() if noted else b""

    def files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def laid() -> Iterator[pa.RecordBatch]:
            for b in batches:
                *rgb, error = b.columns[:5]
                blocks = {"icc": pa.array([profile] * b.num_rows, pa.binary()), "notes": b.column(5)} if noted else {}
                yield pa.RecordBatch.from_arrays([*rgb, *blocks.values(), error], ["img_id", "width", "height", "data", *blocks, "error"])

        return write(laid())

    if noted:
        frames = frames.withColumn("notes", F.struct(*fields))
    return develop_frames(frames, options, ("notes",) if noted else (), then=(files, "content binary, error string"))


def save(files: DataFrame, folder: str, ending: str = "png") -> DataFrame:
    """img_id, path, error of (img_id, content, error): each task writes its files, when the result is computed.

    ``folder`` is a URI that all executors reach. Files are named by img_id, which must tell rows apart, and moved to
    their names when whole, so a task that runs again replaces what it wrote.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from uuid import uuid4

        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        for batch in batches:
            paths: list[str | None] = []
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                path = None if content is None else f"{root}/{quote(str(name), safe='')}.{ending}"
                if path:
                    part = f"{root}/_{uuid4().hex}"
                    with store.open_output_stream(part) as out:
                        out.write(content)
                    store.move(part, path)
                paths.append(path)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(paths, pa.string()), batch.column(2)], ["img_id", "path", "error"])

    return files.select("img_id", "content", "error").mapInArrow(run, f"img_id {dict(files.dtypes)['img_id']}, path string, error string")
