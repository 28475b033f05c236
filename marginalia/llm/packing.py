"""Packing documents into training sequences of bounded length by minimum bin slack.

A document is its ids and an end id. One of more than ``size`` ids is cut into pieces of ``size``,
of which the first may be shorter; any other is one piece. Pieces are then put into as few
sequences as the method finds: a sequence gets the longest piece left, and with it the
combination of other lengths that fills it best, found by dynamic programming over the set
of reachable sums, a bitset.

Only lengths matter for that, and there are at most ``size`` of them. So pieces are counted by
length, and combinations are sought over this bounded table on the driver, whatever the number
of documents: a combination stays the best one for as long as its lengths last, hence it is used
as often as they do, and there are about as many combinations as lengths. Pieces then
take their places by number: a task numbers its pieces of each length while it encodes them, and counts
by (task, length) say where its numbers begin. No length, however frequent, gathers in one task.

Defined cases: a null or empty text is its end id alone; texts of any length are encoded
whole; repeated rows are pieces of their own; an empty table makes no sequence; other columns
play no part, whatever their names. Which of the pieces of one length stands where depends on how
the table is split into tasks; the number of sequences and their fill do not.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marginalia.llm.common import materialise, pieces, ship, texts, trim
from marginalia.llm.repair_tokens import PIECE, encoder, id_widths

SIZE = 2048


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """The combination of at most ``counts[length]`` of each length with the greatest sum up to ``room``.

    Bit s of ``sums`` says that s can be reached. Lengths come from long to short, each in blocks of 1, 2, 4, ... pieces, and
    what a block reaches first is led back through it; so of equal sums the one of longer pieces is taken.
    """
    mask, sums, steps = (1 << (room + 1)) - 1, 1, []
    for length in sorted((n for n in counts if n <= room and counts[n] > 0), reverse=True):
        left, block = min(counts[length], room // length), 1
        while left > 0:
            many = min(block, left)
            steps.append((length, many, sums))
            sums |= (sums << (length * many)) & mask
            left, block = left - many, 2 * block
        if sums >> room:
            break
    at, out = sums.bit_length() - 1, {}
    for length, many, before in reversed(steps):
        if not before >> at & 1:
            out[length] = out.get(length, 0) + many
            at -= length * many
    return out


def minimum_slack(counts: dict[int, int], size: int = SIZE) -> list[tuple[dict[int, int], int]]:
    """Combinations (pieces of each length) and how many sequences each fills; together they use all ``counts``."""
    left, out = {n: c for n, c in counts.items() if c > 0}, []
    while left:
        longest = max(left)
        left[longest] -= 1
        found = fullest(left, size - longest)
        left[longest] += 1
        found[longest] = found.get(longest, 0) + 1
        times = min(left[n] // k for n, k in found.items())
        out.append((found, times))
        for n, k in found.items():
            left[n] -= k * times
            if not left[n]:
                del left[n]
    return out


@dataclass(frozen=True)
class Places:
    """Where the n-th piece of a length stands: runs in order of (length, first number), and what each run's places are.

    Of a combination that fills ``times`` sequences, ``each`` pieces of the length go to a sequence, side by side from ``offset``.
    """

    length: np.ndarray
    begin: np.ndarray
    each: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray

    def of(self, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of each (length, number)."""
        order = np.lexsort((number, length))
        run = np.empty(len(length), np.int64)
        # runs and pieces merge in one order of (length, number); a run comes before a piece of the same number
        at = np.lexsort((np.append(np.zeros(len(self.begin), bool), np.ones(len(order), bool)), np.append(self.begin, number[order]), np.append(self.length, length[order])))
        run[order] = np.cumsum(at < len(self.begin))[at >= len(self.begin)] - 1
        nth = number - self.begin[run]
        return self.sequence[run] + nth // self.each[run], self.offset[run] + nth % self.each[run] * length


def places(combinations: list[tuple[dict[int, int], int]]) -> Places:
    runs, used, sequence = [], {}, 0
    for found, times in combinations:
        offset = 0
        for length in sorted(found, reverse=True):
            each = found[length]
            runs.append((length, used.get(length, 0), each, sequence, offset))
            used[length] = used.get(length, 0) + each * times
            offset += each * length
        sequence += times
    table = np.array(sorted(runs), np.int64).reshape(-1, 5)
    return Places(*table.T)


def encode_pieces(df: DataFrame, path: str, size: int = SIZE, end_id: int = 0) -> DataFrame:
    """A written table of the pieces of ``df`` (doc_id, text): doc_id, piece, start, length, ids (little-endian uint32), task, nth.

    ``nth`` numbers the pieces of one length in one task.
    """
    if not 0 <= end_id < len(id_widths(path)):
        raise ValueError("end_id is no id of the vocabulary")
    kind = df.schema["doc_id"].dataType.simpleString()
    ship(df.sparkSession)
    end = np.uint32(end_id)

    def run(batches):
        task, met = TaskContext.get().partitionId(), np.zeros(size + 1, np.int64)
        for b in (p for batch in batches for p in pieces(batch, chars=PIECE)):
            ids = [np.append(x, end) for x in encoder(path).encode(texts(b))]
            total = np.array([len(x) for x in ids], np.int64)
            many = -(-total // size)
            of = np.repeat(np.arange(len(ids)), many)
            piece = np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)
            head = total - (many - 1) * size  # the first piece takes what full ones leave
            start = np.where(piece > 0, head[of] + (piece - 1) * size, 0)
            length = np.where(piece > 0, size, head[of])
            order = np.argsort(length, kind="stable")
            ranked = length[order]
            nth = np.empty(len(of), np.int64)
            nth[order] = np.arange(len(of)) - np.searchsorted(ranked, ranked) + met[ranked]
            met += np.bincount(length, minlength=size + 1)
            offsets = pa.py_buffer(np.append(0, 4 * np.cumsum(length)).astype(np.int64))
            data = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(of), [None, offsets, pa.py_buffer(np.concatenate(ids).astype("<u4"))])
            columns = {"doc_id": b.column("doc_id").take(pa.array(of)), "piece": pa.array(piece.astype(np.int32)), "start": pa.array(start), "length": pa.array(length), "ids": data.cast(pa.binary())}
            yield pa.RecordBatch.from_arrays([*columns.values(), pa.array(np.full(len(of), task, np.int32)), pa.array(nth)], names=[*columns, "task", "nth"])
        trim()

    schema = f"doc_id {kind}, piece int, start long, length long, ids binary, task int, nth long"
    return materialise(df.select("doc_id", "text").mapInArrow(run, schema), "pack-pieces")


def assign(rows: DataFrame, size: int = SIZE) -> DataFrame:
    """``rows`` (length, task, nth and other columns) with sequence_id and offset instead of task and nth."""
    found = rows.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    found = materialise(found, "pack-counts")
    counts = {r["length"]: r["n"] for r in found.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # ``size`` rows at most
    table = places(minimum_slack(counts, size))

    @F.pandas_udf("struct<sequence_id: long, offset: long>")
    def place(length: pd.Series, number: pd.Series) -> pd.DataFrame:
        sequence, offset = table.of(length.to_numpy(), number.to_numpy())
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    before = F.sum("n").over(Window.partitionBy("length").orderBy("task")) - F.col("n")  # a row per task
    begin = found.select(F.col("length").alias("_length"), F.col("task").alias("_task"), before.alias("_before"))
    kept = [c for c in rows.columns if c not in ("task", "nth")]
    joined = rows.join(begin, (F.col("length") == F.col("_length")) & (F.col("task") == F.col("_task")))
    at = place(F.col("length"), F.col("nth") + F.col("_before"))
    return joined.select(*kept, at.alias("_at")).select(*kept, "_at.sequence_id", "_at.offset")


def pack_documents(df: DataFrame, path: str, size: int = SIZE, end_id: int = 0) -> DataFrame:
    """The pieces of ``df`` (doc_id, text) with their ids and their places: sequence_id, offset."""
    return assign(encode_pieces(df, path, size, end_id), size)


def sequences(packed: DataFrame) -> DataFrame:
    """The sequences themselves: sequence_id, length, doc_ids and ids; a group has one sequence's pieces."""
    row = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids")))
    joined = packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), row.alias("_rows"))
    ids = F.aggregate("_rows", F.lit(b"").cast("binary"), lambda so_far, r: F.concat(so_far, r["ids"]))
    return joined.select("sequence_id", "length", F.col("_rows.doc_id").alias("doc_ids"), ids.alias("ids"))


def checked_places(df: DataFrame, path: str, size: int = SIZE) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of each piece; ids stay where they were written."""
    rows = encode_pieces(df, path, size)
    return assign(rows.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "task", "nth"), size)
