"""Token ids as binary shards in training order.

Documents are tokenized and packed into sequences of equally many tokens. A keyed Feistel permutation over the
next power of four, walked along its cycles until it falls below the number of sequences, gives each sequence its
global slot: a bijection that needs no sort and no table. Slots are dealt by range, one shard after the other, and
a shard is a file of records of one size. A reader finds any slot by arithmetic, reads on in sequence, and resumes
from the last slot's number.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.llm.common import batches_of, written
from corpusmill.session import scratch_path

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how the vocabulary's texts are split before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Ends each record: keeps records apart and shows a reader that it is in step.
MARK = b"\nSEQEND\n"
SEQUENCE = 2_048
SHARD = 4_096
#: Compression of the pieces on their way to the shards: ids of 100 sequences shrink to 55 %, at level 1 to 66 %.
LEVEL = 9
#: Sequences that a task sorts by shard and compresses at a time.
DEALT = 5_000
_M1, _M2, _M64 = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, (1 << 64) - 1


class Shards(NamedTuple):
    """``path`` of the files; ``manifest``: slot, shard, offset, n_tokens, docs; the layout's numbers."""

    path: str
    manifest: DataFrame
    n_sequences: int
    sequence: int
    shard: int
    width: int

    @property
    def stride(self) -> int:
        return 8 + self.sequence * self.width + len(MARK)


def _mixed(x: np.ndarray, key: int) -> np.ndarray:
    """A 64-bit finaliser of ``x`` under a round key."""
    x = x + np.uint64(key & _M64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(_M1)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(_M2)
    return x ^ (x >> np.uint64(31))


def permuted(index: np.ndarray, n: int, key: int = 1, rounds: int = 6) -> np.ndarray:
    """The slot of each index below ``n``: balanced Feistel rounds, repeated for those that fall at ``n`` or above.

    The domain is at most four times ``n``, so that four walks are expected at the most.
    """
    half = np.uint64(max(1, (max(1, n - 1).bit_length() + 1) // 2))
    mask = np.uint64((1 << int(half)) - 1)
    keys = [int.from_bytes(hashlib.sha256(f"{key}:{r}".encode()).digest()[:8], "big") for r in range(rounds)]
    out = np.array(index, np.uint64)
    walking = np.arange(len(out))
    while len(walking):
        left, right = out[walking] >> half, out[walking] & mask
        for k in keys:
            left, right = right, left ^ (_mixed(right, k) & mask)
        out[walking] = (left << half) | right
        walking = walking[out[walking] >= n]
    return out.astype(np.int64)


def vocabulary(path: str = VOCABULARY) -> dict[bytes, int]:
    """Ranks from a file of base64 tokens and numbers."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _packer(ranks, end: int, length: int, dtype: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import tiktoken
        from pyspark import TaskContext

        encode = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks.value, special_tokens={}).encode_ordinary
        part, made = TaskContext.get().partitionId(), 0
        held, docs, pending = [], [], 0  # arrays not yet in a sequence, their documents, their tokens

        def sequences(last: bool) -> pd.DataFrame:
            nonlocal held, docs, pending, made
            tokens = np.concatenate(held) if held else np.empty(0, dtype)
            n = -(-len(tokens) // length) if last else len(tokens) // length
            rows, at, piece = [], 0, 0
            starts = np.cumsum([0, *[d[2] for d in docs]])
            for k in range(n):
                stop = min(len(tokens), (k + 1) * length)
                inside = []
                while piece < len(docs) and starts[piece] < stop:
                    lo, hi = max(at, starts[piece]), min(stop, starts[piece + 1])
                    inside.append((docs[piece][0], int(lo - at), int(docs[piece][1] + lo - starts[piece]), int(hi - lo)))
                    if starts[piece + 1] > stop:
                        break
                    piece += 1
                body = np.full(length, end, dtype)
                body[: stop - at] = tokens[at:stop]
                rows.append((part, made + k, int(stop - at), inside, body.tobytes()))
                at = stop
            made += n
            if last or piece >= len(docs):
                held, docs, pending = [], [], 0
            else:
                done = int(at - starts[piece])
                first = (docs[piece][0], docs[piece][1] + max(0, done), docs[piece][2] - max(0, done))
                held, docs, pending = [tokens[at:]], [first, *docs[piece + 1 :]], len(tokens) - at
            return pd.DataFrame(rows, columns=["part", "idx", "n_tokens", "docs", "tokens"])

        for b in batches:
            for doc, text in zip(b["doc"], b["text"], strict=True):
                ids = np.array([*encode(text), end], dtype)
                held.append(ids)
                docs.append((doc, 0, len(ids)))
                pending += len(ids)
                if pending >= 512 * length:
                    yield sequences(False)
        yield sequences(True)

    return run


def _dealer(n: int, key: int, shard: int, width: int, length: int):
    """Sequences to (shard, blob): those of one batch that go to the same shard, in one compressed piece."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            slots = permuted((b["before"] + b["idx"]).to_numpy(), n, key)
            order = np.argsort(slots)
            edges = np.flatnonzero(np.diff(slots[order] // shard, prepend=-1, append=-1))
            tokens = b["tokens"].to_numpy()
            codec = pa.Codec("zstd", compression_level=LEVEL)
            rows = []
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                at = order[lo:hi]
                raw = slots[at].astype("<u8").tobytes() + b"".join(tokens[at])
                rows.append((int(slots[at[0]] // shard), len(raw), codec.compress(raw, asbytes=True)))
            yield pd.DataFrame(rows, columns=["shard", "size", "blob"])

    return run


def _assembler(width: int, length: int):
    """One shard's pieces to its records in the order of slots."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        records: list[tuple[int, bytes]] = []
        body = width * length
        for b in batches:
            for size, blob in zip(b["size"], b["blob"], strict=True):
                raw = pa.decompress(blob, decompressed_size=int(size), codec="zstd", asbytes=True)
                k = len(raw) // (8 + body)
                slots = np.frombuffer(raw[: 8 * k], "<u8")
                records += [(int(s), raw[8 * k + i * body : 8 * k + (i + 1) * body]) for i, s in enumerate(slots)]
        records.sort(key=lambda r: r[0])
        for i in range(0, len(records), 1_024):
            yield pd.DataFrame({"value": [s.to_bytes(8, "little") + t for s, t in records[i : i + 1_024]]})

    return run


def write_shards(
    docs: DataFrame,
    path: str | None = None,
    id_col: str = "doc_id",
    text: str = "text",
    ranks: dict[bytes, int] | None = None,
    sequence: int = SEQUENCE,
    shard: int = SHARD,
    key: int = 1,
) -> Shards:
    """Files of records (slot as 8 bytes, ``sequence`` token ids, a mark) and the manifest of what is in each slot.

    Every document's tokens and one end token follow one another; a sequence may hold several documents and a long
    document spans several. Each task's last sequence is filled with end tokens. A null text is left out, an empty one
    is its end token; repeated rows come as often as they are there; only id and text are read. An empty table writes
    no shard. Ids take two bytes, or four if the vocabulary needs them.

    ``docs`` in the manifest: (doc, at: place in the sequence, from: the document's first token there, n).
    ``key`` chooses the order. Sequences are written once, so a retried task finds the same ones in the same place.
    """
    spark = docs.sparkSession
    ranks = ranks or vocabulary()
    end = max(ranks.values()) + 1
    dtype = "<u2" if end < 1 << 16 else "<u4"
    width = np.dtype(dtype).itemsize
    path = path or scratch_path(spark, "shards")
    typed = f"array<struct<doc:{docs.schema[id_col].dataType.simpleString()},at:int,from:long,n:int>>"
    pack = _packer(spark.sparkContext.broadcast(ranks), end, sequence, dtype)
    slim = docs.where(F.col(text).isNotNull()).select(F.col(id_col).cast("string").alias("doc"), F.col(text).cast("string").alias("text"))
    schema = "part int, idx long, n_tokens int, docs array<struct<doc:string,at:int,from:long,n:int>>, tokens binary"
    packed = written(slim.mapInPandas(pack, schema), "sequences")
    # One row for each task that packed.
    counts = packed.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    n = counts.agg(F.sum("n")).first()[0] or 0
    placed = packed.join(F.broadcast(before), "part")
    if n:
        dealt = placed.select("before", "idx", "tokens").mapInPandas(_dealer(n, key, shard, width, sequence), "shard int, size long, blob binary")
        files = -(-n // shard)
        records = dealt.repartitionById(files, F.col("shard")).mapInPandas(_assembler(width, sequence), "value binary")
        with batches_of(spark, DEALT):
            records.select(F.col("value").cast("string").alias("value")).write.option("lineSep", MARK.decode()).text(path)

    @F.pandas_udf("long")
    def slot(index: pd.Series) -> pd.Series:
        return pd.Series(permuted(index.to_numpy(), n, key))

    stride = 8 + sequence * width + len(MARK)
    manifest = placed.select(slot(F.col("before") + F.col("idx")).alias("slot"), "n_tokens", "docs").select(
        "slot", F.expr(f"slot div {shard}").alias("shard"), (F.col("slot") % shard * stride).alias("offset"), "n_tokens", F.col("docs").cast(typed).alias("docs")
    )
    return Shards(path, manifest, n, sequence, shard, width)


def records(content: bytes, stride: int, start: int = 0) -> Iterator[tuple[int, bytes]]:
    """(slot, token bytes) of a shard's content from its record ``start`` on; an error if a record is out of step."""
    for at in range(start * stride, len(content), stride):
        if content[at + stride - len(MARK) : at + stride] != MARK:
            raise ValueError(f"no record at byte {at}")
        yield int.from_bytes(content[at : at + 8], "little"), content[at + 8 : at + stride - len(MARK)]


def read_slots(spark: SparkSession, shards: Shards, start: int = 0) -> DataFrame:
    """(slot, tokens) from slot ``start`` on; only the shards from that slot's on are opened."""
    schema = "slot long, tokens binary"
    if start >= shards.n_sequences:
        return spark.createDataFrame([], schema)
    first, stride, per_shard = start // shards.shard, shards.stride, shards.shard
    files = -(-shards.n_sequences // per_shard)
    paths = [f"{shards.path}/part-{k:05d}-*" for k in range(first, files)] if first else [f"{shards.path}/part-*"]

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for content in b["content"]:
                skip = max(0, start - int.from_bytes(content[:8], "little"))
                rows = list(records(content, stride, skip))
                for i in range(0, len(rows), 1_024):
                    yield pd.DataFrame(rows[i : i + 1_024], columns=["slot", "tokens"])

    return spark.read.format("binaryFile").load(paths).select("content").mapInPandas(cut, schema)
