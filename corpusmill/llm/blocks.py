"""Texts in blocks: rows of a few megabytes that tasks work on with arrays, written once so that every pass sees the same.

A block asks the owners of hash ranges about many hashes in one compressed row, and gets one row back. Work between
texts that would need a row for each hash so moves as packed arrays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import as_bytes, written

BLOCK_BYTES = 4 << 20
#: A row without an id sorts after all others.
NO_ID = (1 << 63) - 1
SCHEMA = "block string, ids binary, marks binary, ends binary, size long, texts binary"


def squeezed(*arrays: np.ndarray) -> bytes:
    """The arrays' bytes, compressed; the total size comes first. Bytes of equal weight stand together, as they are alike."""
    raw = b"".join(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), -1).T.tobytes() if len(a) else b"" for a in arrays)
    return len(raw).to_bytes(8, "little") + (pa.compress(raw, codec="zstd", asbytes=True) if raw else b"")


def spread(blob: bytes, *kinds: str) -> list[np.ndarray]:
    """The equally long arrays of these types that ``squeezed`` packed."""
    size = int.from_bytes(blob[:8], "little")
    raw = pa.decompress(blob[8:], decompressed_size=size, codec="zstd", asbytes=True) if size else b""
    n = size // sum(np.dtype(k).itemsize for k in kinds)
    out, at = [], 0
    for k in kinds:
        width = np.dtype(k).itemsize
        planes = np.frombuffer(raw, np.uint8, n * width, at).reshape(width, n)
        out.append(np.ascontiguousarray(planes.T).view(k).reshape(n))
        at += n * width
    return out


def blocks(docs: DataFrame, id_col: str, text: str, mark=None, size: int | None = None) -> DataFrame:
    """Written rows of SCHEMA: ids and ends of the texts, a byte ``mark`` for each, and the texts, compressed.

    The id must be a whole number; a null id is NO_ID, a null text an empty one. A text larger than ``size`` is a
    block of its own.
    """

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, made = TaskContext.get().partitionId(), 0
        ids, marks, texts, total = [], [], [], 0

        def row() -> pd.DataFrame:
            raw = b"".join(texts)
            ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
            blob = pa.Codec("zstd", compression_level=3).compress(raw, asbytes=True) if raw else b""
            one = (f"{part}-{made}", np.array(ids, np.int64).tobytes(), np.array(marks, np.uint8).tobytes(), ends.tobytes(), len(raw), blob)
            return pd.DataFrame([one], columns=["block", "ids", "marks", "ends", "size", "texts"])

        for b in batches:
            for i, m, t in zip(b["id"], b["mark"], b["text"], strict=True):
                if texts and total + len(t) > size:
                    yield row()
                    made, ids, marks, texts, total = made + 1, [], [], [], 0
                ids.append(i)
                marks.append(m)
                texts.append(t)
                total += len(t)
        if texts:
            yield row()

    size = size or BLOCK_BYTES
    mark = F.lit(0) if mark is None else mark
    slim = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), mark.cast("int").alias("mark"), as_bytes(text).alias("text"))
    return written(slim.mapInPandas(pack, SCHEMA), "blocks", "uncompressed")


def unpacked(row) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """(ids, marks, texts) of a block's row."""
    raw = pa.decompress(row.texts, decompressed_size=int(row.size_), codec="zstd", asbytes=True) if row.size_ else b""
    ends = np.frombuffer(row.ends, np.int64)
    starts = np.concatenate(([0], ends[:-1])) if len(ends) else ends
    return np.frombuffer(row.ids, np.int64), np.frombuffer(row.marks, np.uint8), [raw[a:b] for a, b in zip(starts, ends, strict=True)]


def each(frame: pd.DataFrame):
    """The rows of a frame of blocks."""
    return frame.rename(columns={"size": "size_"}).itertuples(index=False)


def bucket_of(hashes: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The owner of each 64-bit hash and the next 40 bits of its place there, both ascending with the hash.

    Owners have equal ranges: the product of hash and ``buckets``, in 128 bits, has the owner above its 64th bit.
    """
    low = (hashes & np.uint64(0xFFFFFFFF)) * np.uint64(buckets)
    product = (hashes >> np.uint64(32)) * np.uint64(buckets) + (low >> np.uint64(32))
    place = ((product & np.uint64(0xFFFFFFFF)) << np.uint64(8)) | ((low >> np.uint64(24)) & np.uint64(0xFF))
    return product >> np.uint64(32), place


def slices(bucket: np.ndarray) -> list[tuple[int, int, int]]:
    """(bucket, begin, end) of each run of an ascending array."""
    if not len(bucket):
        return []
    edges = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])).tolist()
    return [(int(bucket[x]), x, y) for x, y in zip(edges, [*edges[1:], len(bucket)], strict=True)]


def steps(ascending: np.ndarray) -> np.ndarray:
    """Differences of ascending numbers; their bytes are fewer."""
    return np.diff(ascending, prepend=ascending.dtype.type(0))


def from_steps(differences: np.ndarray) -> np.ndarray:
    return np.cumsum(differences, dtype=differences.dtype)
