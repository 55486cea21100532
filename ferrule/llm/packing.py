"""Token ids packed into rows of one length, as a training run reads them.

Documents become token ids with an end mark behind each.  What is longer than a
row is split, without loss, into full rows and a rest; rests and short documents
are packed by best-fit decreasing: longest first, each into the row with the
least room that still holds it.  The rows' room is kept in a segment tree over
capacities, so that a search takes the logarithm of a row's length, however many
rows are open.

Each task packs its own split of the table in stretches of at most STRETCH
tokens.  So nothing is shuffled, memory is bounded, and a lost task packs the
same rows again.  The price is the last, less full rows of a stretch.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from ferrule.llm.bpe import load_ranks
from ferrule.llm.common import shared_dir

#: Tokens that are packed together.
STRETCH = 1 << 22


class Capacities:
    """How many bins have each capacity, in a segment tree that finds the least sufficient one."""

    def __init__(self, most: int):
        self.size = 1 << most.bit_length()
        self.count = [0] * (2 * self.size)
        self.bins: list[list[int]] = [[] for _ in range(most + 1)]

    def put(self, capacity: int, number: int) -> None:
        self.bins[capacity].append(number)
        i = capacity + self.size
        while i:
            self.count[i] += 1
            i >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """A bin of the least capacity from `need` on, with that capacity; the bin opened first among equals' last."""
        count, i = self.count, need + self.size
        # climb until a subtree to the right holds a bin, then go down to its leftmost leaf
        if not count[i]:
            while True:
                if i == 1:
                    return None
                if not i & 1 and count[i + 1]:
                    i += 1
                    break
                i >>= 1
            while i < self.size:
                i = 2 * i if count[2 * i] else 2 * i + 1
        capacity = i - self.size
        number = self.bins[capacity].pop()
        while i:
            count[i] -= 1
            i >>= 1
        return number, capacity


def best_fit_decreasing(lengths: list[int], most: int) -> list[list[int]]:
    """Bins of item numbers, none over `most` in all; no item may be longer.  Items of equal length keep their order."""
    free, bins = Capacities(most), []
    for item in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        need = lengths[item]
        got = free.take(need)
        if got is None:
            bins.append([item])
            left, number = most - need, len(bins) - 1
        else:
            number, left = got[0], got[1] - need
            bins[number].append(item)
        if left:
            free.put(left, number)
    return bins


def position_ids(cu_seqlens) -> np.ndarray:
    """Places of a row's tokens in their segments: counting from 0 again at each of the resets."""
    at = np.asarray(cu_seqlens)
    return np.arange(at[-1]) - np.repeat(at[:-1], np.diff(at))


_SCHEMA = "split int, stretch int, row int, ids binary, n_tokens int, cu_seqlens array<int>, resets array<int>, doc_ids array<bigint>, starts array<bigint>"
_FIELDS = [("split", pa.int32()), ("stretch", pa.int32()), ("row", pa.int32()), ("ids", pa.binary()), ("n_tokens", pa.int32()), ("cu_seqlens", pa.list_(pa.int32())), ("resets", pa.list_(pa.int32())), ("doc_ids", pa.list_(pa.int64())), ("starts", pa.list_(pa.int64()))]


def pack(docs: DataFrame, ranks_path: str, pattern: str, *, length: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of at most `length` token ids.

    ids holds `length` ids, little-endian, of 2 bytes where the vocabulary and
    its end mark (the id behind the last) allow it, else of 4; behind n_tokens
    they are end marks that belong to no segment.  cu_seqlens are the segments'
    borders from 0 to n_tokens, resets the places where position ids begin at 0
    again, doc_ids the document of each segment and starts its first token's
    place in the document's ids.  (split, stretch, row) names a row.

    A null or empty text is its end mark alone.  A null id stays null in doc_ids;
    documents with one id are separate ones.  Other columns are ignored.
    """
    if length < 2:
        raise ValueError("length must be 2 at least")
    spark = docs.sparkSession
    ranks = spark.sparkContext.broadcast(load_ranks(ranks_path))
    rows = docs.selectExpr(f"cast(`{id_col}` as bigint) as id", f"coalesce(cast(`{text_col}` as string), '') as text")

    def run(batches):
        import tiktoken

        encoder = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks.value, special_tokens={})
        end = max(ranks.value.values(), default=-1) + 1
        kind = np.dtype("<u2" if end < 1 << 16 else "<u4")
        split, stretch = TaskContext.get().partitionId(), 0
        pieces: list[np.ndarray] = []
        owners: list[tuple[int | None, int]] = []
        held = 0

        def done():
            nonlocal pieces, owners, held, stretch
            sizes = [len(p) for p in pieces]
            out = []
            for row, items in enumerate(best_fit_decreasing(sizes, length)):
                at = np.r_[0, np.cumsum([sizes[i] for i in items])].astype(np.int32)
                ids = np.full(length, end, kind)
                ids[: at[-1]] = np.concatenate([pieces[i] for i in items])
                out.append((split, stretch, row, ids.tobytes(), int(at[-1]), at, at[:-1], [owners[i][0] for i in items], [owners[i][1] for i in items]))
            stretch += 1
            pieces, owners, held = [], [], 0
            for a in range(0, len(out), 1024):
                cols = zip(*out[a : a + 1024], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, _FIELDS, strict=True)], names=[n for n, _ in _FIELDS])

        for batch in batches:
            idents, texts = batch.column(0), batch.column(1)
            for r in range(batch.num_rows):
                ids = np.array([*encoder.encode_ordinary(texts[r].as_py()), end], kind)
                owner = idents[r].as_py()
                for a in range(0, len(ids), length):
                    pieces.append(ids[a : a + length])
                    owners.append((owner, a))
                held += len(ids)
                if held >= STRETCH:
                    yield from done()
        yield from done()

    return rows.mapInArrow(run, _SCHEMA)


def write(packed: DataFrame, path: str | None = None) -> str:
    """Write packed rows as Parquet, to `path` or a new folder of the shared one; returns the folder."""
    path = path or shared_dir(packed.sparkSession)
    packed.write.mode("overwrite").parquet(path)
    return path


def unpack(row, kind: str = "<u2") -> list[tuple[int | None, int, np.ndarray]]:
    """The segments of a packed row: (doc_id, start, ids)."""
    ids = np.frombuffer(row["ids"], kind)
    at = row["cu_seqlens"]
    return [(d, s, ids[a:b]) for d, s, a, b in zip(row["doc_ids"], row["starts"], at, at[1:], strict=False)]


