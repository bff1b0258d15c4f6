"""Best-fit packing of token pieces, certified by dual feasible functions.

Texts become ids plus an end id; only longer ones are cut. Pieces are dealt to partitions
of a bounded number of rows, each packed by best-fit decreasing. Dual feasible functions
give a lower bound of each partition's bins; where the packing meets it, it is final.
Elsewhere the pieces of bins that are not full are released, dealt anew among fewer
partitions, and packed again, until no gap is left or one partition holds what remains.
At most FINAL_ROWS pieces meet in one task, so where more are left over than that, a few
partitions stay, each packed by itself and perhaps with a bin more than its bound.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .byte_bpe import encode
from .tables import named, stash

CAPACITY = 1024
END_ID = 2
PART_ROWS = 1 << 15
FINAL_ROWS = 1 << 18  # at most so many released pieces meet in one partition


def _cut(path: str, capacity: int, end_id: int, with_ids: bool, names: list[str]):
    """Pieces of each text: the first may be shorter, the others fill a sequence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, ids, at in encode(batch.column("text"), path):
                doc, piece, start, length, crc, kept = [], [], [], [], [], []
                for d in range(j - i):
                    own = np.append(ids[at[d] : at[d + 1]], np.uint32(end_id)).astype("<u4")
                    first = len(own) % capacity or capacity
                    lo, hi, k = 0, first, 0
                    while lo < len(own):
                        doc.append(d)
                        piece.append(k)
                        start.append(lo)
                        length.append(hi - lo)
                        crc.append(zlib.crc32(own[lo:hi].tobytes()))
                        if with_ids:
                            kept.append(own[lo:hi].view(np.int32).tolist())
                        lo, hi, k = hi, hi + capacity, k + 1
                out = [batch.column("doc_id").slice(i, j - i).take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                yield pa.record_batch(out + ([pa.array(kept, pa.list_(pa.int32()))] if with_ids else []), names=names)

    return run


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32[, ids], pid), stashed; null text is empty."""
    base = docs.select(named(id_col).alias("doc_id"), named(text_col).cast("string").alias("text"))
    kind = base.schema["doc_id"].dataType.simpleString()
    shape = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    names = [x.split()[0] for x in shape.split(", ")]
    return stash(base.mapInArrow(_cut(tokenizer_path, capacity, end_id, with_ids, names), shape).withColumn("pid", F.monotonically_increasing_id()))


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """(bin, offset) of each item and the room left in each bin; items come longest first."""
    bins, offsets, room = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_rooms = 0  # bit r is set while a bin has r left
    for i, size in enumerate(lengths.tolist()):
        fitting = open_rooms >> size
        if fitting:
            r = size + (fitting & -fitting).bit_length() - 1
            b = by_room[r].pop()
            if not by_room[r]:
                open_rooms &= ~(1 << r)
        else:
            r, b = capacity, len(room)
            room.append(capacity)
        bins[i], offsets[i] = b, capacity - r
        r -= size
        room[b] = r
        if r:
            by_room[r].append(b)
            open_rooms |= 1 << r
    return bins, offsets, room


def least_bins(lengths: np.ndarray, capacity: int) -> int:
    """Lower bound on bins: the best of two families of dual feasible functions."""
    if not len(lengths):
        return 0
    count = np.bincount(lengths, minlength=capacity + 1)
    size = np.flatnonzero(count)
    count = count[size]
    best = -(-int((size * count).sum()) // capacity)
    for eps in np.unique(size[2 * size <= capacity]).tolist():  # small items vanish, large ones count as a bin
        value = np.where(size > capacity - eps, capacity, np.where(size < eps, 0, size))
        best = max(best, -(-int((value * count).sum()) // capacity))
    for k in range(1, 64):  # sizes rounded to multiples of 1/k unless (k+1) * size is whole
        scaled = size * (k + 1)
        value = np.where(scaled % capacity == 0, size * k, (scaled // capacity) * capacity)
        best = max(best, -(-int((value * count).sum()) // (k * capacity)))
    return best


def _pack(capacity: int, round_no: int, last: bool):
    def run(table: pa.Table) -> pa.Table:
        pid, length, part = (table.column(c).to_numpy() for c in ("pid", "length", "part"))
        order = np.lexsort((pid, -length))
        pid, length = pid[order], length[order]
        bins, offsets, room = best_fit_decreasing(length, capacity)
        certified = len(room) == least_bins(length, capacity)
        open_bin = (np.array(room) > 0)[bins] & (not last and not certified)
        number = (np.int64(round_no) << 56) + (np.int64(part[0]) << 24) + bins
        return pa.table({"pid": pid, "length": length, "sequence_id": pa.array(number, mask=open_bin), "offset": pa.array(offsets, mask=open_bin), "certified": np.full(len(pid), certified)})

    return run


def pack(items: DataFrame, capacity: int = CAPACITY, part_rows: int = PART_ROWS) -> DataFrame:
    """Rows (pid, length, sequence_id, offset, certified) for items(pid, length), all < capacity.

    certified: the bins of the row's last partition are proven to be as few as possible.
    """
    shape = "pid long, length long, sequence_id long, offset long, certified boolean"
    left, n, done, round_no = items.select("pid", "length"), items.count(), [], 0
    parts, stuck = max(1, -(-n // part_rows)), False
    while True:
        dealt = left.withColumn("part", F.pmod(F.xxhash64("pid", F.lit(round_no)), F.lit(parts)))
        last = parts == 1 or stuck
        out = stash(dealt.groupBy("part").applyInArrow(_pack(capacity, round_no, last), shape))
        done.append(out.where("sequence_id is not null"))
        if last:
            break
        left = out.where("sequence_id is null").select("pid", "length")
        n, round_no = left.count(), round_no + 1
        if not n:
            break
        fewer = max(1, -(-n // FINAL_ROWS), min(-(-n // part_rows), parts // 4))
        parts, stuck = min(parts, fewer), fewer >= parts
    placed = done[0]
    for more in done[1:]:
        placed = placed.unionByName(more)
    return placed


def packed(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset).

    Each row of the input is a document of its own, repeated rows too, and null ids are ids;
    a null text or an empty one is the end id alone. An empty table gives no rows. Other
    columns are not read.
    """
    cut = pieces(docs, tokenizer_path, capacity, end_id, with_ids, id_col, text_col)
    payload = ["ids"] if with_ids else []
    lead = ["doc_id", "piece", "start", "length", "ids_crc32", *payload]
    full = cut.where(F.col("length") == capacity).select(*lead, (-1 - F.col("pid")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    some = cut.where(F.col("length") < capacity)
    placed = pack(some, capacity).select("pid", "sequence_id", "offset")
    return full.unionByName(some.join(placed, "pid").select(*lead, "sequence_id", "offset"))
