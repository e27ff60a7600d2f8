"""Builds TIFF trees for tests."""

import struct

LETTERS = {1: "B", 2: "s", 3: "H", 4: "I", 5: "I", 7: "s", 8: "h", 10: "i", 12: "d"}


def tiff(tops, order="<", blobs=(), gap=b""):
    """tops: directories in chain. A directory maps a tag to (type, values), to a list of directories (a pointer
    tag), or to ("blob", index) for offsets of blobs, ("blobs", [indices]) for several. Blobs follow at the end; gap stands after the header."""
    flat = []

    def add(directory):
        at = len(flat)
        flat.append(directory)
        children = {}
        for tag, v in directory.items():
            if isinstance(v, list):
                children[tag] = [add(x) for x in v]
        flat[at] = (directory, children)
        return at

    chain = [add(x) for x in tops]

    def size(d):
        n = 2 + 12 * len(d[0]) + 4
        for tag, v in d[0].items():
            data = payload(d, tag, v, None)[2]
            n += len(data) + len(data) % 2 if len(data) > 4 else 0
        return n

    def payload(d, tag, v, places):
        if isinstance(v, list):
            at = [places[0][i] for i in d[1][tag]] if places else [0] * len(d[1][tag])
            return 4, len(at), struct.pack(f"{order}{len(at)}I", *at)
        if v[0] in ("blob", "blobs"):
            which = [v[1]] if v[0] == "blob" else v[1]
            at = [places[1][i] for i in which] if places else [0] * len(which)
            return 4, len(at), struct.pack(f"{order}{len(at)}I", *at)
        kind, values = v
        if LETTERS[kind] == "s":
            return kind, len(values), bytes(values)
        return kind, len(values) // (2 if kind in (5, 10) else 1), struct.pack(f"{order}{len(values)}{LETTERS[kind]}", *values)

    starts, at = [], 8 + len(gap)
    for d in flat:
        starts.append(at)
        at += size(d)
    blob_at = []
    for b in blobs:
        blob_at.append(at)
        at += len(b)
    out = (b"II\x2a\0" if order == "<" else b"MM\0\x2a") + struct.pack(order + "I", starts[chain[0]]) + gap
    for i, d in enumerate(flat):
        entries, rest, place = b"", b"", starts[i] + 2 + 12 * len(d[0]) + 4
        for tag in sorted(d[0]):
            kind, n, data = payload(d, tag, d[0][tag], (starts, blob_at))
            entries += struct.pack(order + "HHI", tag, kind, n)
            if len(data) > 4:
                entries += struct.pack(order + "I", place + len(rest))
                rest += data + b"\0" * (len(data) % 2)
            else:
                entries += data.ljust(4, b"\0")
        after = starts[chain[chain.index(i) + 1]] if i in chain and i != chain[-1] else 0
        out += struct.pack(order + "H", len(d[0])) + entries + struct.pack(order + "I", after) + rest
    return out + b"".join(blobs)


def box(kind, body):
    return struct.pack(">I4s", 8 + len(body), kind) + body
