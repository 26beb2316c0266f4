"""Benchmark decontamination by a prefix-filtered set join.

Every benchmark item is cut into item-sized windows (13 words, or the whole of a shorter item). A window is a set of
shingles of up to five words. The shingles are ordered by how rare they are in the corpus, counted over all documents.
Containment must be complete, so the necessary prefix of a window is its one rarest shingle: documents are joined on
it. The shingle's offset in the window and the window's length bound the place where the window could stand in the
document (positional and length filter); there the words are compared one by one.

Items are handled in blocks of a bounded size, each broadcast; a larger benchmark means more blocks, never a larger
broadcast. Hits come back as word ranges, which are united over the blocks.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, text_rows

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
STEP = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[bytes]:
    """A-Z lower-cased; words are letters, digits and everything beyond ASCII."""
    return WORD.findall(text.encode("utf-8", "surrogatepass").lower()) if text else []


@dataclass
class Windows:
    """The distinct windows of one length, as numbers of words, a row each; whose they are: of row r the items
    ``owner[at[r]:at[r + 1]]``."""

    rows: np.ndarray
    at: np.ndarray
    owner: np.ndarray


@dataclass
class ItemBlock:
    """Windows of some items; in them 0 stands for words that no item has."""

    vocabulary: dict[bytes, int]
    names: list[str]
    windows: list[Windows]
    #: by shingle length: sorted keys of all shingles
    shingles: dict[int, np.ndarray]
    #: by shingle length: sorted keys of the prefixes, and which Windows, row and offset each leads to
    leads: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]


def shingle_keys(ids: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit key for each run of ``size`` words; 0 where a word of no item is among them."""
    if len(ids) < size:
        return np.zeros(0, np.uint64)
    n = len(ids) - size + 1
    key, known = np.zeros(n, np.uint64), np.ones(n, bool)
    for k in range(size):
        part = ids[k : k + n]
        key = (key ^ part.astype(np.uint64)) * STEP
        key ^= key >> np.uint64(29)
        known &= part > 0
    return np.where(known, key | np.uint64(1), np.uint64(0))


def row_keys(rows: np.ndarray, size: int) -> np.ndarray:
    """``shingle_keys`` of each row."""
    n = rows.shape[1] - size + 1
    key = np.zeros((len(rows), n), np.uint64)
    for k in range(size):
        key = (key ^ rows[:, k : k + n].astype(np.uint64)) * STEP
        key ^= key >> np.uint64(29)
    return key | np.uint64(1)


def block_of(items: list[tuple[str, str]], window: int, shingle: int) -> ItemBlock:
    vocabulary: dict[bytes, int] = {}
    texts = [np.array([vocabulary.setdefault(w, len(vocabulary) + 1) for w in words_of(text)], np.int32) for _, text in items]
    lengths = np.array([len(t) for t in texts], np.int64)
    flat, first = np.concatenate([*texts, np.zeros(0, np.int32)]), np.cumsum(lengths) - lengths
    block = ItemBlock(vocabulary, [name for name, _ in items], [], {}, {})
    keys: dict[int, list[np.ndarray]] = {}
    for width in np.unique(np.minimum(lengths, window)).tolist():
        if not width:
            continue
        own = np.flatnonzero(np.minimum(lengths, window) == width)
        times = lengths[own] - width + 1
        item = np.repeat(own, times)
        start = np.repeat(first[own] - (np.cumsum(times) - times), times) + np.arange(times.sum())
        rows = np.ascontiguousarray(flat[start[:, None] + np.arange(width)])
        _, place, same = np.unique(rows.view(np.dtype((np.void, 4 * width))).reshape(-1), return_index=True, return_inverse=True)
        pairs = np.unique(same.reshape(-1).astype(np.int64) * len(items) + item)
        at = np.searchsorted(pairs // len(items), np.arange(len(place) + 1))
        block.windows.append(Windows(rows[place], at, (pairs % len(items)).astype(np.int32)))
        size = min(shingle, width)
        keys.setdefault(size, []).append(np.unique(row_keys(rows[place], size)))
    block.shingles = {n: np.unique(np.concatenate(k)) for n, k in keys.items()}
    return block


def choose_prefixes(block: ItemBlock, counts: dict[int, np.ndarray], shingle: int) -> None:
    """For each window its rarest shingle, of equals the first; ``counts`` are in the order of ``block.shingles``."""
    found: dict[int, list[tuple[np.ndarray, ...]]] = {}
    for number, windows in enumerate(block.windows):
        size = min(shingle, windows.rows.shape[1])
        for lo in range(0, len(windows.rows), 100_000):
            keys = row_keys(windows.rows[lo : lo + 100_000], size)
            offset = counts[size][np.searchsorted(block.shingles[size], keys)].argmin(1)
            n = np.arange(len(keys))
            found.setdefault(size, []).append((keys[n, offset], np.full(len(n), number, np.int16), (lo + n).astype(np.int32), offset.astype(np.int16)))
    for size, parts in found.items():
        key, number, row, offset = (np.concatenate(c) for c in zip(*parts, strict=True))
        order = np.argsort(key, kind="stable")
        block.leads[size] = (key[order], number[order], row[order], offset[order])


def _ids(block: ItemBlock, words: list[bytes]) -> np.ndarray:
    get = block.vocabulary.get
    return np.fromiter((get(w, 0) for w in words), np.int64, len(words))


def _count(docs: DataFrame, shared) -> dict[int, np.ndarray]:
    """How often each shingle of the block occurs in the whole corpus: summed in each task, then over the tasks."""

    def run(batches):
        block = shared.value
        sums = {n: np.zeros(len(k), np.int64) for n, k in block.shingles.items()}
        for batch in batches:
            for text in batch.column(1).to_pylist():
                ids = _ids(block, words_of(text))
                if not ids.any():
                    continue
                for n, known in block.shingles.items():
                    keys = shingle_keys(ids, n)
                    keys = keys[keys > 0]
                    at = np.searchsorted(known, keys)
                    at[at == len(known)] = 0
                    np.add.at(sums[n], at[known[at] == keys], 1)
        for n, total in sums.items():
            some = np.flatnonzero(total)
            for start in range(0, len(some), 10_000):
                part = some[start : start + 10_000]
                yield pa.RecordBatch.from_arrays([pa.array([n] * len(part), pa.int32()), pa.array(part, pa.int64()), pa.array(total[part], pa.int64())], ["size", "place", "n"])

    out = {n: np.zeros(len(k), np.int64) for n, k in shared.value.shingles.items()}
    for r in docs.mapInArrow(run, "size int, place long, n long").groupBy("size", "place").agg(F.sum("n").alias("n")).toLocalIterator():
        out[r["size"]][r["place"]] = r["n"]
    return out


def find_windows(block: ItemBlock, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
    """Word ranges of the document that windows cover, and the items that they come from."""
    ids, ranges, items = _ids(block, words), [], set()
    if not ids.any():
        return ranges, items
    for n, (known, number, row, offset) in block.leads.items():
        keys = shingle_keys(ids, n)
        places = np.flatnonzero(keys)
        low, high = (np.searchsorted(known, keys[places], side) for side in ("left", "right"))
        some = high > low
        for place, a, b in zip(places[some].tolist(), low[some].tolist(), high[some].tolist(), strict=True):
            for which in np.unique(number[a:b]).tolist():
                windows = block.windows[which]
                width = windows.rows.shape[1]
                lead = a + np.flatnonzero(number[a:b] == which)
                start = place - offset[lead].astype(np.int64)
                lead, start = lead[(start >= 0) & (start + width <= len(ids))], start[(start >= 0) & (start + width <= len(ids))]
                same = (ids[start[:, None] + np.arange(width)] == windows.rows[row[lead]]).all(1)
                for begin, r in zip(start[same].tolist(), row[lead[same]].tolist(), strict=True):
                    ranges.append((begin, begin + width))
                    items.update(block.names[k] for k in windows.owner[windows.at[r] : windows.at[r + 1]].tolist())
    return ranges, items


def united(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _blocks(items: DataFrame, block_bytes: int) -> Iterator[list[tuple[str, str]]]:
    """Items in blocks of at most about ``block_bytes`` of text each, fetched one after the other."""
    size = items.agg(F.sum(F.length("body").cast("long"))).first()[0] or 0
    n = int(size // block_bytes) + 1
    dealt = items.withColumn("block", F.pmod(F.xxhash64("id", "body"), F.lit(n)))
    for k in range(n):
        rows = (dealt if n == 1 else dealt.where(F.col("block") == k)).select("id", "body").toLocalIterator()
        yield [(r["id"], r["body"]) for r in rows]


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 13, shingle: int = 5, share: float = 0.05, block_bytes: int = 8_000_000) -> DataFrame:
    """A row for each document row: its id, n_words, n_hit, n_items, items_sha256, contaminated, hit_ranges (word
    ranges, end exclusive) and items. ``contaminated``: some word is hit and hits are at least ``share`` of the words.
    Null and empty texts have no words and are clean. Items without words have no window. Rows of one item id share
    it; repeated document rows give repeated rows."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = text_rows(docs, id_col, text_col)
    items = benchmark.select(F.col(f"`{item_col}`").cast("string").alias("id"), F.col(f"`{item_text_col}`").cast("string").alias("body")).where("id is not null and body is not null")
    id_type = rows.schema["id"].dataType.simpleString()
    limit = int(round(1 / share))
    shape = f"id {id_type}, mark long, n_words long, starts array<int>, ends array<int>, items array<string>"
    told = f"id {id_type}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, hit_ranges array<string>, items array<string>"
    marked = rows.withColumn("mark", F.xxhash64("body"))
    found: list[DataFrame] = []
    blocks = _shared_blocks(rows, items, window, shingle, block_bytes)

    def finished(batch):
        hit, joined, ranges = [], [], []
        for a, b, o in zip(batch.column("starts").to_pylist(), batch.column("ends").to_pylist(), batch.column("items").to_pylist(), strict=True):
            spans = united(list(zip(a, b, strict=True)))
            ranges.append([f"{x}:{y}" for x, y in spans])
            hit.append(sum(y - x for x, y in spans))
            joined.append(hashlib.sha256(",".join(sorted(o)).encode()).hexdigest())
        n = batch.column("n_words").to_pylist()
        owners = batch.column("items").to_pylist()
        return pa.RecordBatch.from_arrays(
            [batch.column("id"), batch.column("n_words"), pa.array(hit, pa.int64()), pa.array([len(o) for o in owners], pa.int64()), pa.array(joined, pa.string()), pa.array([h > 0 and limit * h >= k for h, k in zip(hit, n, strict=True)], pa.bool_()), pa.array(ranges, pa.list_(pa.string())), pa.array([sorted(o) for o in owners], pa.list_(pa.string()))],
            ["id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "hit_ranges", "items"],
        )

    for shared in blocks:

        def run(batches, shared=shared):
            block = shared.value
            for batch in batches:
                n, starts, ends, owners = [], [], [], []
                for text in batch.column(1).to_pylist():
                    words = words_of(text)
                    ranges, got = find_windows(block, words)
                    ranges = united(ranges)
                    n.append(len(words))
                    starts.append([a for a, _ in ranges])
                    ends.append([b for _, b in ranges])
                    owners.append(sorted(got))
                got = pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(starts, pa.list_(pa.int32())), pa.array(ends, pa.list_(pa.int32())), pa.array(owners, pa.list_(pa.string()))], ["id", "mark", "n_words", "starts", "ends", "items"])
                yield finished(got) if len(blocks) == 1 else got

        if len(blocks) == 1:  # one Python worker for each task does both steps
            return marked.mapInArrow(run, told).withColumnRenamed("id", id_col)
        found.append(marked.mapInArrow(run, shape))
    # What the blocks found in a row is united; a row that stands k times comes k times from each block.
    merged = reduce(DataFrame.unionByName, found)
    same = merged.groupBy("id", "mark").agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_list("starts")).alias("starts"), F.flatten(F.collect_list("ends")).alias("ends"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"), (F.count("*") / len(found)).cast("int").alias("times"))
    merged = same.withColumn("times", F.explode(F.sequence(F.lit(1), "times"))).drop("times", "mark")
    return merged.mapInArrow(lambda batches: map(finished, batches), told).withColumnRenamed("id", id_col)


def _shared_blocks(rows: DataFrame, items: DataFrame, window: int, shingle: int, block_bytes: int) -> list:
    """Each block with its prefixes chosen, as a broadcast of bounded size."""
    out = []
    for got in _blocks(items, block_bytes):
        block = block_of(got, window, shingle)
        first = rows.sparkSession.sparkContext.broadcast(block)
        choose_prefixes(block, _count(rows, first) if block.windows else {}, shingle)
        first.unpersist()
        block.shingles = {}
        out.append(rows.sparkSession.sparkContext.broadcast(block))
    return out
