"""Texts as 8-bit grey PNG images in binary columns, read back with checksum tests, and a cosine-transform hash of each.

Bytes are padded to rows of 64 samples.  The writer takes, for each image, the filter of none, sub and up whose
residues are least in sum; the reader undoes all five filters with numpy, whole runs of rows at a time where the
filter allows it.  The image data go out as zlib chunks of at most CHUNK bytes.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lodestrata.llm.common import map_text, stored, take_memory

WIDTH = 64
CHUNK = 1 << 16
SIGN = b"\x89PNG\r\n\x1a\n"
SIDE, LOW = 32, 8


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def filtered(rows: np.ndarray) -> np.ndarray:
    """Rows with a filter byte before each: none, sub or up, whichever leaves the least residues."""
    sub = rows.copy()
    sub[:, 1:] -= rows[:, :-1]
    up = rows.copy()
    up[1:] -= rows[:-1]
    cost = [int(np.abs(x.view(np.int8).astype(np.int16)).sum()) for x in (rows, sub, up)]
    kind = int(np.argmin(cost))
    out = np.empty((len(rows), rows.shape[1] + 1), np.uint8)
    out[:, 0] = kind
    out[:, 1:] = (rows, sub, up)[kind]
    return out


def unfiltered(raw: np.ndarray) -> np.ndarray:
    """Undo filters 0 to 4 (none, sub, up, average, Paeth) of one-byte pixels."""
    kinds, rows = raw[:, 0], raw[:, 1:].copy()
    if kinds.max(initial=0) > 4:
        raise ValueError("unknown PNG filter")
    starts = np.flatnonzero(np.diff(kinds, prepend=kinds[:1] + 1 if len(kinds) else 0))
    for a, b in zip(starts, [*starts[1:], len(kinds)]):
        kind = int(kinds[a])
        above = rows[a - 1] if a else np.zeros(rows.shape[1], np.uint8)
        if kind == 1:
            np.cumsum(rows[a:b], axis=1, dtype=np.uint8, out=rows[a:b])
        elif kind == 2:
            rows[a] += above
            np.cumsum(rows[a:b], axis=0, dtype=np.uint8, out=rows[a:b])
        elif kind:
            _along_diagonals(rows[a:b], above, _average if kind == 3 else _paeth)
    return rows


def _average(left: np.ndarray, up: np.ndarray, corner: np.ndarray) -> np.ndarray:
    return (left + up) >> 1


def _paeth(left: np.ndarray, up: np.ndarray, corner: np.ndarray) -> np.ndarray:
    da, db, dc = np.abs(up - corner), np.abs(left - corner), np.abs(left + up - 2 * corner)
    return np.where((da <= db) & (da <= dc), left, np.where(db <= dc, up, corner))


def _along_diagonals(rows: np.ndarray, above: np.ndarray, guess) -> None:
    """Undo a filter that needs the samples to the left, above and in the corner.  Those of a diagonal need only the two
    diagonals before it, so whole diagonals are done at once: height + width steps, and not one for each sample."""
    h, w = rows.shape
    done = np.zeros((h + 1, w + 1), np.int32)
    done[0, 1:] = above
    for d in range(h + w - 1):
        r = np.arange(max(0, d - w + 1), min(h, d + 1))
        c = d - r
        done[r + 1, c + 1] = (rows[r, c] + guess(done[r + 1, c], done[r, c + 1], done[r, c])) & 255
    rows[:] = done[1:, 1:]


def encode(payload: bytes, width: int = WIDTH, level: int = 3) -> bytes:
    """A grey 8-bit PNG of payload, whose length is a positive multiple of width."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, width)
    data = zlib.compress(filtered(rows).tobytes(), level)
    head = struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)
    body = b"".join(_chunk(b"IDAT", data[i : i + CHUNK]) for i in range(0, len(data), CHUNK))
    return SIGN + _chunk(b"IHDR", head) + body + _chunk(b"IEND", b"")


def decode(media: bytes) -> np.ndarray:
    """Samples (height, width) of a grey 8-bit PNG; ValueError if a signature, length, checksum or header is wrong."""
    if media[:8] != SIGN:
        raise ValueError("no PNG signature")
    at, size, data, ended = 8, None, [], False
    while at < len(media) and not ended:
        if at + 12 > len(media):
            raise ValueError("PNG chunk cut short")
        n, kind = struct.unpack_from(">I4s", media, at)
        body = media[at + 8 : at + 8 + n]
        if len(body) != n or at + 12 + n > len(media):
            raise ValueError("PNG chunk cut short")
        if struct.unpack_from(">I", media, at + 8 + n)[0] != zlib.crc32(body, zlib.crc32(kind)):
            raise ValueError(f"PNG checksum of {kind!r} is wrong")
        if kind == b"IHDR":
            width, height, *form = struct.unpack(">IIBBBBB", body)
            if form != [8, 0, 0, 0, 0]:
                raise ValueError("only grey 8-bit images without interlace are read")
            size = height, width
        elif kind == b"IDAT":
            data.append(body)
        ended = kind == b"IEND"
        at += 12 + n
    if size is None or not ended or at != len(media):
        raise ValueError("PNG without header or end, or with bytes behind it")
    raw = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8)
    if raw.size != size[0] * (size[1] + 1):
        raise ValueError("PNG data of another length than the header says")
    return unfiltered(raw.reshape(size[0], size[1] + 1))


def _cosines() -> np.ndarray:
    k, x = np.arange(LOW)[:, None], np.arange(SIDE)[None, :]
    return np.cos(np.pi * (2 * x + 1) * k / (2 * SIDE))


_COS = _cosines()


def cosine_hash(image: np.ndarray) -> str:
    """64 bits as hex: which of the low LOW x LOW cosine coefficients of the image, averaged to SIDE x SIDE, exceed
    the median of all but the first.  Images of fewer than SIDE rows or columns repeat theirs."""
    h, w = image.shape
    rows = np.cumsum(image, axis=0, dtype=np.int64)
    at = (np.arange(SIDE + 1) * h) // SIDE
    low, high = at[:-1], np.maximum(at[1:], at[:-1] + 1)
    upper = np.where(low[:, None] > 0, rows[low - 1], 0)
    bands = (rows[high - 1] - upper) / (high - low)[:, None]
    at = (np.arange(SIDE + 1) * w) // SIDE
    low, high = at[:-1], np.maximum(at[1:], at[:-1] + 1)
    cols = np.cumsum(bands, axis=1)
    left = np.where(low[None, :] > 0, cols[:, low - 1], 0)
    small = (cols[:, high - 1] - left) / (high - low)[None, :]
    c = np.round(_COS @ small @ _COS.T, 6).reshape(-1)
    bits = c > np.median(c[1:])
    return np.packbits(bits).tobytes().hex()


MEDIA_FIELDS = T.StructType([T.StructField("n_bytes", T.LongType(), False), T.StructField("media", T.BinaryType(), False)])
FEATURE_FIELDS = T.StructType(
    [
        T.StructField("n_bytes", T.LongType(), False),
        T.StructField("payload_bytes", T.LongType(), False),
        T.StructField("payload_sha256", T.StringType(), False),
        T.StructField("tail_crc32", T.LongType(), False),
        T.StructField("media_bytes", T.LongType(), False),
        T.StructField("media_sha256", T.StringType(), False),
        T.StructField("feature", T.StringType(), False),
    ]
)


def payload_of(text: str | None, unit: int = WIDTH) -> tuple[int, bytes]:
    """The length of the text in UTF-8, and its bytes padded with 0 to a positive multiple of unit."""
    b = (text or "").encode("utf-8", "surrogatepass")
    return len(b), b + bytes(max(unit, -(-len(b) // unit) * unit) - len(b))


def to_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, media: each text's PNG as a binary column, stored in the shared folder.

    Null and empty texts become 64 zero bytes; equal texts equal images; rows that repeat, and null ids, stay as they
    are; an empty table gives no rows.  Other columns are ignored, whatever their names.
    """

    def make():
        take_memory("png")

        def step(texts: list) -> dict:
            both = [payload_of(t) for t in texts]
            return {"n_bytes": [n for n, _ in both], "media": [encode(p) for _, p in both]}

        return step

    return stored(map_text(docs, [id_col], text_col, make, MEDIA_FIELDS), "media")


def media_features(media: DataFrame, id_col: str = "doc_id", size_col: str = "n_bytes", media_col: str = "media") -> DataFrame:
    """Digests and the cosine hash of what the stored images hold, read back from their bytes.

    A row per row; rows that repeat and null ids stay as they are; an empty table gives no rows.  A null image, or one
    that a checksum, a length or the header shows to be damaged, ends the job with an error.
    """
    out = T.StructType([f for f in FEATURE_FIELDS if f.name != "n_bytes"])

    def make():
        take_memory("png")

        def step(images: list) -> dict:
            got: dict[str, list] = {f.name: [] for f in out}
            for m in images:
                image = decode(m)
                payload = image.tobytes()
                row = (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), len(m), hashlib.sha256(m).hexdigest(), cosine_hash(image))
                for name, v in zip(got, row):
                    got[name].append(v)
            return got

        return step

    return map_text(media, [id_col, size_col], media_col, make, out)
