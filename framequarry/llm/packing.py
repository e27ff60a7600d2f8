"""Hierarchical packing of token sequences into several window lengths.

Windows are powers of two: a window of the longest tier is a whole context, shorter ones fill step
groups of equal token counts. Documents are routed: each full context of a long document is a
window of its own, and what is left goes to the tier whose window it fits (over half of one).
Every tier is packed from the longest down; the gap that a piece leaves in its window is filled
from the shorter tiers, longest fitting piece first, cutting the last one to close the gap. What
remains at the end of a block is split into power-of-two windows, so only a rest shorter than the
least window is padded.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..ship import ship
from .tokens import Encoder, slices

CONTEXT = 1024
LEAST = 64
BLOCK_TOKENS = 1 << 20
SCHEMA = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, tier int, step_group bigint"


def tier_of(length: int, context: int = CONTEXT, least: int = LEAST) -> int:
    """The shortest window, a power of two from least to context, that holds length."""
    return min(context, max(least, 1 << (length - 1).bit_length()))


def pack_block(lengths: list[int], context: int = CONTEXT, least: int = LEAST) -> list[tuple[int, list[tuple[int, int, int]]]]:
    """Windows of one block: (tier, [(document, start, length)]); every token of every document is in one piece.

    Each window but at most one is full. Zero lengths have no piece. The result depends on the lengths' order alone.
    """
    windows: list[tuple[int, list[tuple[int, int, int]]]] = []
    tiers: dict[int, list[tuple[int, int, int]]] = {least << k: [] for k in range((context // least).bit_length())}
    order, left = sorted(tiers), 0

    def route(n: int, d: int, start: int) -> None:
        nonlocal left
        if n:
            tiers[tier_of(n, context, least)].append((n, d, start))
            left += n

    def take(size: int) -> tuple[int, int, int]:
        nonlocal left
        piece = tiers[size].pop()
        left -= piece[0]
        return piece

    for d, n in enumerate(lengths):
        start = 0
        while n - start >= context:
            windows.append((context, [(d, start, context)]))
            start += context
        route(n - start, d, start)
    for t in tiers.values():
        t.sort(key=lambda p: (p[0], -p[1]))  # the longest is taken first, from the end
    while left:
        size = max(s for s in order if tiers[s])
        window = size if left >= size else 1 << (left.bit_length() - 1) if left >= least else context
        pieces, gap, piece = [], window, take(size)
        while True:
            n, d, start = piece
            use = min(n, gap)
            pieces.append((d, start, use))
            gap -= use
            route(n - use, d, start + use)
            if not gap or not left:
                break
            # a shorter tier's piece that fits as it is, else the shortest tier's, cut
            fits = [s for s in order if s <= gap and tiers[s]]
            piece = take(fits[-1] if fits else next(s for s in order if tiers[s]))
        windows.append((window if not gap else context, pieces))
    return windows


def step_groups(windows: list[tuple[int, list]], tokens: int = 16 * CONTEXT) -> list[int]:
    """A group number per window: windows by tier, in groups of about equal token counts, a group of one tier where that tier fills it."""
    order = sorted(range(len(windows)), key=lambda i: -windows[i][0])
    groups, at = [0] * len(windows), 0
    for i in order:
        groups[i] = at // tokens
        at += windows[i][0]
    return groups


def _packer(tokenizer: str, block_tokens: int, context: int, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, part = Encoder.of(tokenizer), TaskContext.get().partitionId()
        ids: list[int | None] = []
        tokens: list[np.ndarray] = []
        size = windows_before = groups_before = 0

        def flush() -> pa.RecordBatch:
            nonlocal size, windows_before, groups_before
            order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0))
            windows = pack_block([len(tokens[i]) for i in order], context, least)
            groups = step_groups(windows, 16 * context)
            cols: list[list] = [[] for _ in range(9)]
            for k, (tier, pieces) in enumerate(windows):
                offset = 0
                for d, start, length in pieces:
                    i = order[d]
                    b = tokens[i]
                    row = (ids[i], start, length, zlib.crc32(b[start : start + length]), len(b), (part << 40) + windows_before + k, offset, tier, (part << 40) + groups_before + groups[k])
                    for c, v in zip(cols, row, strict=True):
                        c.append(v)
                    offset += length
            windows_before += len(windows)
            groups_before += max(groups, default=-1) + 1
            ids.clear()
            tokens.clear()
            size = 0
            names = [x.split()[0] for x in SCHEMA.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if n == "tier" else pa.int64()) for n, c in zip(names, cols, strict=True)], names)

        for batch in batches:
            for some in slices(batch, 1):
                values, ends = encoder.encode(some.column(1))
                for doc, a, e in zip(some.column(0).to_pylist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                    ids.append(doc)
                    tokens.append(values[a:e])
                    size += e - a
                    if size >= block_tokens:
                        yield flush()
        if ids:
            yield flush()

    return run


def pack(docs: DataFrame, tokenizer: str, block_tokens: int = BLOCK_TOKENS, context: int = CONTEXT, least: int = LEAST) -> DataFrame:
    """One row per piece (SCHEMA): where each document's ids stand in windows of at most ``context``.

    Null text counts as empty; each document ends with id 0, so it has one id at least and none is
    lost. Documents are packed in blocks of about ``block_tokens`` within a task, so memory is
    bounded by a block and the longest document, and texts are not shuffled. A sequence_id is the
    task's number and a count; ``tier`` is the window's length, the context if it is padded. Repeated
    rows are packed each; an empty table gives no row. If an executor is lost, a task is packed anew
    as a whole. Other columns are not used.
    """
    ship(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(_packer(tokenizer, block_tokens, context, least), SCHEMA)
