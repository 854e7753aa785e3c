"""Packing of documents into token windows by minimum bin slack.

Every document is encoded once and cut into pieces: full windows, and one rest. Packing needs only
how many rests of each length there are, at most one count per length below the window, however
large the corpus. A window starts with the longest rest left; subset sums over the remaining counts
(one bit per sum) show the largest sum that still fits, and walking the bits back gives how many
rests of each length make it. The multiset found is repeated for as many windows as the counts
allow, so each search uses up a length and the searches are bounded by the lengths, not the rows.
Ranks of the pieces within their length then say which window and offset each piece takes.

Results for odd input: a null or empty text is one piece, the end id alone. Repeated rows are
packed each. A document of a whole number of windows has no rest. An empty table gives no rows.
Padding to the window is none where the length of a sequence is a power of two.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querylight.llm.registry import query, table
from querylight.operators.numbering import number_rows
from querylight.session import stage

WINDOW = 2048
END_ID = 1
SPECIAL = "<|endoftext|>"


@lru_cache(maxsize=2)
def exact_coder(model: str):
    """The tokenizer itself; it takes much memory, and few texts need it."""
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(model))


@lru_cache(maxsize=2)
def quick_coder(ranks: str):
    """A quicker coder of the same vocabulary for texts without special tokens."""
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(ranks), "rb") as lines:
        merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={})


def encode(text: str, model: str, ranks: str) -> np.ndarray:
    """Ids of `tokenizers` for one text; the quick coder gives the same for all but special tokens."""
    if SPECIAL in text:
        return np.array(exact_coder(model).encode(text, add_special_tokens=False).ids, dtype=np.uint32)
    return quick_coder(ranks).encode_to_numpy(text).astype(np.uint32)


def pieces(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = WINDOW,
    end_id: int = END_ID,
    model: str = "byte_bpe_50k.json",
    ranks: str = "byte_bpe_50k.tiktoken",
    keep_ids: bool = False,
) -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens[, ids]): each document cut at multiples of the window."""
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, start long, length int, ids_crc32 long, doc_tokens long" + (", ids array<int>" if keep_ids else "")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, text in zip(batch["id"], batch["text"]):
                ids = np.append(encode(text, model, ranks), np.uint32(end_id)).astype("<u4")
                for start in range(0, len(ids), window):
                    part = ids[start : start + window]
                    row = (key, start, len(part), zlib.crc32(part.tobytes()), len(ids))
                    rows.append((*row, part.astype(np.int32)) if keep_ids else row)
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])
            out["id"] = out["id"].astype(batch["id"].dtype) if len(out) and batch["id"].notna().all() else out["id"]
            yield out

    return docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text")).mapInPandas(cut, schema)


def best_fill(counts: np.ndarray, room: int) -> list[tuple[int, int]]:
    """(length, count) of rests whose sum is the largest within `room`, longest lengths first."""
    reach, steps, mask = 1, [], (2 << room) - 1
    for length in range(min(room, len(counts) - 1), 0, -1):
        left, k = int(min(counts[length], room // length)), 1
        while left:
            k = min(k, left)
            steps.append((reach, length, k))
            reach |= (reach << (length * k)) & mask
            left, k = left - k, 2 * k
        if reach >> room:
            break
    total, used = reach.bit_length() - 1, {}
    for before, length, k in reversed(steps):
        if not (before >> total) & 1:
            total -= length * k
            used[length] = used.get(length, 0) + k
    return sorted(used.items(), reverse=True)


def fill_windows(counts: np.ndarray, window: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """(number of windows, their multiset of lengths) until every piece has its place."""
    counts, found = counts.copy(), []
    for longest in range(window, 0, -1):
        while counts[longest]:
            counts[longest] -= 1
            used = dict(best_fill(counts[: longest + 1], window - longest))
            counts[longest] += 1
            used[longest] = used.get(longest, 0) + 1
            times = int(min(counts[length] // n for length, n in used.items()))
            for length, n in used.items():
                counts[length] -= times * n
            found.append((times, sorted(used.items(), reverse=True)))
    return found


class Seats:
    """Where the pieces of each length go: runs of ranks, one per multiset that holds the length."""

    def __init__(self, fills: list[tuple[int, list[tuple[int, int]]]]):
        runs: dict[int, list[tuple[int, int, int, int]]] = {}
        taken: dict[int, int] = {}
        first = 0
        for times, used in fills:
            offset = 0
            for length, n in used:
                runs.setdefault(length, []).append((taken.get(length, 0), n, first, offset))
                taken[length] = taken.get(length, 0) + times * n
                offset += length * n
            first += times
        self.runs = {length: np.array(rows, dtype=np.int64) for length, rows in runs.items()}

    def find(self, lengths: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        for length in np.unique(lengths):
            rows, at = self.runs[int(length)], np.flatnonzero(lengths == length)
            run = rows[np.searchsorted(rows[:, 0], ranks[at], side="right") - 1]
            nth = ranks[at] - run[:, 0]
            sequence[at] = run[:, 2] + nth // run[:, 1]
            offset[at] = run[:, 3] + nth % run[:, 1] * length
        return sequence, offset


def pack(cut: DataFrame, window: int = WINDOW) -> DataFrame:
    """`cut` (pieces with id, start, length and what else they carry) with sequence_id and offset."""
    cut = stage(cut, "pieces")
    counts = np.zeros(window + 1, dtype=np.int64)
    for length, n in cut.groupBy("length").count().collect():  # at most `window` rows
        counts[length] = n
    seats = Seats(fill_windows(counts, window))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sequence, offset = seats.find(batch["length"].to_numpy(), batch["rank"].to_numpy())
            yield batch.drop(columns="rank").assign(sequence_id=sequence, offset=offset)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema)
    ranked = number_rows(cut, ["length"], ["id", "start", "ids_crc32"], out="rank")
    ordered = ranked.select(*cut.columns, F.col("rank").cast("long"))
    return ordered.mapInPandas(place, f"{kinds}, sequence_id long, offset long")


def pack_documents(docs: DataFrame) -> DataFrame:
    """One row per piece of `docs` (doc_id, text, …)."""
    return pack(pieces(docs)).select(
        F.col("id").alias("doc_id"),
        "start",
        F.col("length").cast("long").alias("length"),
        "ids_crc32",
        "doc_tokens",
        "sequence_id",
        "offset",
    )


@query("op10_packing")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
