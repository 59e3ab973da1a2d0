"""Benchmark decontamination with a distributed positional inverted index.

``build_index`` cuts the corpus into blocks and stores, for every block, the sorted dictionary of
its terms and for every term the list of its positions: a document-partitioned index, written once
as Parquet into the shared folder. ``find_phrases`` and ``find_near`` then search items in it. For
a phrase, the list of the term that is rarest in the block gives the candidate starts (position
less the term's place in the phrase); they are intersected with the equally adjusted lists of the
other terms, from rare to frequent, until only exact occurrences are left. No text is read again.

Items are searched in bounded chunks (``chunk_words``), so neither the driver nor a task ever holds
more than one chunk, however large the benchmark is; each chunk is one pass over the index.

Defined cases: a null or wordless text has no words and no matches; an item without words matches
nothing; items with a null id mark words but are not listed, and ids of items may be of any type that text
can be cast back to; ids of documents are integers; every row of the corpus is a document
of its own, also with a null or repeated id; extra columns are ignored; empty tables give no rows
or no matches. Terms are looked up by a 64-bit hash and then compared byte by byte.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlake.llm.store import new_path
from wardlake.llm.text import slices, words

WINDOW = 10
BLOCK_BYTES = 4 << 20
CHUNK_WORDS = 200_000
CANDIDATES = 2_000_000  # places intersected at a time

INDEX = (
    "block string, ids array<bigint>, doc_ends binary, terms binary, names binary,"
    " name_ends binary, counts binary, positions binary"
)
_INDEX_ARROW = pa.schema(
    [("block", pa.string()), ("ids", pa.list_(pa.int64()))]
    + [(name, pa.binary()) for name in
       ("doc_ends", "terms", "names", "name_ends", "counts", "positions")]
)


def _pack(values: np.ndarray | bytes) -> bytes:
    raw = values if isinstance(values, bytes) else np.ascontiguousarray(values).tobytes()
    return zstandard.ZstdCompressor(level=1).compress(raw)


def _unpack(packed: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), kind)


class Block:
    """The postings of one block: terms sorted by hash, positions ascending within a term."""

    def __init__(self, row: dict):
        self.ids = row["ids"]
        self.doc_ends = _unpack(row["doc_ends"], np.uint32).astype(np.int64)
        self.terms = _unpack(row["terms"], np.uint64)
        self.names = _unpack(row["names"], np.uint8)
        self.name_ends = _unpack(row["name_ends"], np.uint32).astype(np.int64)
        self.counts = _unpack(row["counts"], np.uint32).astype(np.int64)
        self.list_ends = np.cumsum(self.counts)
        steps = _unpack(row["positions"], np.uint32).astype(np.int64)
        total = np.cumsum(steps)
        begins = self.list_ends - self.counts
        offset = total[begins] - steps[begins] if len(steps) else total
        self.positions = total - np.repeat(offset, self.counts)
        # Ascending over all lists, so that one binary search tests (term, position) pairs.
        self.keys = (np.repeat(np.arange(len(self.counts)), self.counts) << 32) | self.positions

    @staticmethod
    def rows(ids: list, texts: pa.Array) -> dict:
        found = words(texts)
        order = np.argsort(found.hashes, kind="stable")
        sorted_hashes = found.hashes[order]
        first = np.ones(len(order), bool)
        first[1:] = sorted_hashes[1:] != sorted_hashes[:-1]
        begins = np.flatnonzero(first)
        names, name_ends = found.names(order[begins])
        steps = np.diff(order, prepend=0)
        steps[begins] = order[begins]
        return {
            "ids": ids,
            "doc_ends": _pack(found.text_ends.astype(np.uint32)),
            "terms": _pack(sorted_hashes[begins]),
            "names": _pack(names),
            "name_ends": _pack(name_ends.astype(np.uint32)),
            "counts": _pack(np.diff(begins, append=len(order)).astype(np.uint32)),
            "positions": _pack(steps.astype(np.uint32)),
        }

    def lookup(self, hashes: np.ndarray, names: list[bytes]) -> np.ndarray:
        """Place of each term in the block's dictionary, -1 where the block lacks it."""
        if not len(self.terms):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.terms, hashes), len(self.terms) - 1)
        at[self.terms[at] != hashes] = -1
        for k in np.flatnonzero(at >= 0):
            end = self.name_ends[at[k]]
            begin = self.name_ends[at[k] - 1] if at[k] else 0
            if self.names[begin:end].tobytes() != names[k]:
                at[k] = -1
        return at

    def documents(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.doc_ends, positions, "right")

    def intersect(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Occurrences of phrases (rows of dictionary places) as (phrase, start) pairs."""
        whole = np.flatnonzero((terms >= 0).all(axis=1))
        counts = self.counts[terms[whole]] if len(whole) else np.zeros((0, terms.shape[1]), int)
        rarity = np.argsort(counts, axis=1, kind="stable")
        sizes = counts.min(axis=1, initial=2**62) if len(whole) else counts[:, :0].sum(axis=1)
        found, begin, totals = [], 0, np.cumsum(sizes)
        while begin < len(whole):
            before = totals[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(totals, before + CANDIDATES, "right")))
            rows = np.arange(begin, end)
            rarest = terms[whole[rows], rarity[rows, 0]]
            size = sizes[rows]
            phrase = np.repeat(rows, size)
            list_begin = self.list_ends[rarest] - self.counts[rarest]
            places = np.arange(len(phrase)) + np.repeat(list_begin - (np.cumsum(size) - size), size)
            start = self.positions[places] - rarity[phrase, 0]
            keep = start >= 0
            phrase, start = phrase[keep], start[keep]
            for k in range(1, terms.shape[1]):
                if not len(start):
                    break
                offset = rarity[phrase, k]
                wanted = (terms[whole[phrase], offset] << 32) | (start + offset)
                at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
                keep = self.keys[at] == wanted
                phrase, start = phrase[keep], start[keep]
            if len(start):
                inside = self.documents(start) == self.documents(start + terms.shape[1] - 1)
                found.append((whole[phrase[inside]], start[inside]))
            begin = end
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return tuple(np.concatenate(part) for part in zip(*found, strict=True))


def build_index(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    block_bytes: int = BLOCK_BYTES, path: str | None = None,
) -> DataFrame:
    """Write the positional index of all rows and return it as read back from ``path``."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            for part in slices(batch, "text", block_bytes):
                row = Block.rows(part.column(0).to_pylist(), part.column(1))
                row["block"] = f"{name}-{number}"
                number += 1
                yield pa.RecordBatch.from_pylist([row], schema=_INDEX_ARROW)

    spark = docs.sparkSession
    path = path or new_path(spark, "positions")
    chosen = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    chosen.mapInArrow(blocks, INDEX).write.parquet(path)
    return spark.read.schema(INDEX).parquet(path)


class Items:
    """One bounded chunk of items: their words as places in a common list of terms."""

    def __init__(self, ids: list, texts: list):
        found = words(pa.array(texts, pa.string()))
        self.ids = ids
        self.hashes, first, self.codes = np.unique(
            found.hashes, return_index=True, return_inverse=True
        )
        blob, ends = found.names(first)
        self.names = [blob[b:e] for b, e in zip([0, *ends[:-1].tolist()], ends.tolist())]
        self.begins = np.concatenate([[0], found.text_ends[:-1]]).astype(np.int64)
        self.sizes = found.text_ends - self.begins

    def windows(self, window: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """By length: the item of each window, and its words."""
        for length in np.unique(np.minimum(self.sizes, window)):
            if not length:
                continue
            own = np.flatnonzero(np.minimum(self.sizes, window) == length)
            n = self.sizes[own] - length + 1
            item = np.repeat(own, n)
            begin = np.arange(n.sum()) + np.repeat(self.begins[own] - (np.cumsum(n) - n), n)
            yield item, self.codes[begin[:, None] + np.arange(length)]


def item_chunks(
    items: DataFrame, id_col: str, text_col: str, chunk_words: int = CHUNK_WORDS
) -> Iterator[Items]:
    """Items in chunks of about ``chunk_words`` words; the driver holds one at a time."""
    ids, texts, size = [], [], 0
    chosen = items.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).alias("t"))
    for row in chosen.where("t is not null").toLocalIterator():
        ids.append(row.i)
        texts.append(row.t)
        size += 1 + len(row.t) // 5
        if size >= chunk_words:
            yield Items(ids, texts)
            ids, texts, size = [], [], 0
    if ids:
        yield Items(ids, texts)


_DOC_HITS = (
    "block string, row int, doc_id bigint, n_words bigint,"
    " spans array<struct<begin: int, end: int>>, items array<string>"
)


def _phrase_hits(chunk: Items | None, window: int):
    """Per block: every document with the merged word ranges hit and the items found in it."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                block = Block(row)
                total = int(block.doc_ends[-1]) if len(block.doc_ends) else 0
                change, pairs = np.zeros(total + 1, np.int64), []
                at = block.lookup(chunk.hashes, chunk.names) if chunk else np.zeros(0, np.int64)
                for item, codes in chunk.windows(window) if chunk else ():
                    phrase, start = block.intersect(at[codes])
                    np.add.at(change, start, 1)
                    np.add.at(change, start + codes.shape[1], -1)
                    pairs.append(np.unique(block.documents(start) * len(chunk.ids) + item[phrase]))
                hit = np.concatenate([[False], np.cumsum(change[:-1]) > 0, [False]])
                doc_begins = np.concatenate([[0], block.doc_ends[:-1]]).astype(np.int64)
                edges = np.flatnonzero(hit[1:] != hit[:-1])
                spans: dict[int, list] = {}
                for begin, end in edges.reshape(-1, 2).tolist():
                    for doc in range(int(block.documents(begin)), int(block.documents(end - 1)) + 1):
                        first, last = int(doc_begins[doc]), int(block.doc_ends[doc])
                        if max(begin, first) < min(end, last):
                            spans.setdefault(doc, []).append(
                                {"begin": max(begin, first) - first, "end": min(end, last) - first}
                            )
                items: dict[int, list] = {}
                for pair in np.unique(np.concatenate(pairs)).tolist() if pairs else ():
                    doc, item = divmod(pair, len(chunk.ids))
                    if chunk.ids[item] is not None:
                        items.setdefault(doc, []).append(chunk.ids[item])
                n = len(block.ids)
                yield pa.RecordBatch.from_arrays([
                    pa.array([row["block"]] * n, pa.string()),
                    pa.array(range(n), pa.int32()),
                    pa.array(block.ids, pa.int64()),
                    pa.array(block.doc_ends - doc_begins, pa.int64()),
                    pa.array([spans.get(d, []) for d in range(n)],
                             pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))),
                    pa.array([items.get(d, []) for d in range(n)], pa.list_(pa.string())),
                ], names=["block", "row", "doc_id", "n_words", "spans", "items"])

    return search


def _covered(spans: Column) -> Column:
    """Words in the union of ranges."""
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    return F.aggregate(
        F.array_sort(spans), start,
        lambda a, s: F.struct(
            (a["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(s["begin"], a["end"]))).alias("n"),
            F.greatest(a["end"], s["end"]).alias("end"),
        ),
        lambda a: a["n"].cast("long"),
    )


def find_phrases(
    index: DataFrame, items: DataFrame, window: int = WINDOW,
    id_col: str = "item_id", text_col: str = "text", chunk_words: int = CHUNK_WORDS,
) -> DataFrame:
    """Every document with the word ranges that items' windows cover and the items found.

    A window is ``window`` consecutive words of an item; an item of fewer words is one window.
    """
    spark = index.sparkSession
    path = new_path(spark, "phrase-hits")
    searched = False
    for chunk in item_chunks(items, id_col, text_col, chunk_words):
        hits = index.mapInArrow(_phrase_hits(chunk, window), _DOC_HITS)
        hits.write.mode("append").parquet(path)
        searched = True
    if not searched:
        index.mapInArrow(_phrase_hits(None, window), _DOC_HITS).write.parquet(path)
    hits = spark.read.schema(_DOC_HITS).parquet(path)
    merged = hits.groupBy("block", "row").agg(
        F.first("doc_id").alias("doc_id"),
        F.first("n_words").alias("n_words"),
        F.flatten(F.collect_list("spans")).alias("spans"),
        F.flatten(F.collect_list("items")).alias("items"),
    )
    return merged.select(
        "doc_id", "n_words", _covered(F.col("spans")).alias("n_hit"), "spans",
        F.array_sort(F.transform(F.array_distinct("items"), lambda i: i.cast(items.schema[id_col].dataType)))
        .alias("items"),
    )


_NEAR_HITS = "doc_id bigint, item_id string, begin int, end int"


def find_near(
    index: DataFrame, items: DataFrame, within: int,
    id_col: str = "item_id", text_col: str = "text", chunk_words: int = CHUNK_WORDS,
) -> DataFrame:
    """Proximity matches: ranges of at most ``within`` words that hold all terms of an item.

    Order and repeats of the item's words do not matter. Each occurrence of the item's rarest term
    is looked at with the words up to ``within`` - 1 before and after it; one row is returned for
    every shortest range (no proper part of it holds all terms), with word places in the document.
    """
    chunks = item_chunks(items, id_col, text_col, chunk_words)
    spark, path, searched = index.sparkSession, new_path(index.sparkSession, "near-hits"), False

    def searcher(chunk: Items):
        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in range(batch.num_rows):
                    block = Block(batch.slice(k, 1).to_pylist()[0])
                    at = block.lookup(chunk.hashes, chunk.names)
                    rows = []
                    for item in np.flatnonzero(chunk.sizes):
                        begin = chunk.begins[item]
                        terms = np.unique(at[chunk.codes[begin:begin + chunk.sizes[item]]])
                        if terms[0] >= 0:
                            rows += _nearby(block, terms, within, chunk.ids[item])
                    yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([
                        ("doc_id", pa.int64()), ("item_id", pa.string()),
                        ("begin", pa.int32()), ("end", pa.int32())]))
        return search

    for chunk in chunks:
        index.mapInArrow(searcher(chunk), _NEAR_HITS).write.mode("append").parquet(path)
        searched = True
    found = spark.read.schema(_NEAR_HITS).parquet(path) if searched else spark.createDataFrame([], _NEAR_HITS)
    return found.withColumn("item_id", F.col("item_id").cast(items.schema[id_col].dataType))


def _nearby(block: Block, terms: np.ndarray, within: int, item_id: str | None) -> list[dict]:
    lists = sorted(
        (block.positions[block.list_ends[t] - block.counts[t]:block.list_ends[t]] for t in terms),
        key=len,
    )
    anchors = lists[0]
    for other in lists[1:]:  # anchors with every other term close enough
        right = np.searchsorted(other, anchors - within + 1, "left")
        near = (right < len(other)) & (other[np.minimum(right, len(other) - 1)] < anchors + within)
        anchors = anchors[near]
    found: set[tuple[int, int, int]] = set()
    for anchor in anchors.tolist():
        doc = int(block.documents(np.int64(anchor)))
        first = int(block.doc_ends[doc - 1]) if doc else 0
        low = max(first, anchor - within + 1)
        high = min(int(block.doc_ends[doc]), anchor + within)
        places = sorted(
            (int(p), k) for k, own in enumerate(lists)
            for p in own[np.searchsorted(own, low):np.searchsorted(own, high)]
        )
        last: dict[int, int] = {}
        best = -1
        for place, k in places:
            last[k] = place
            left = min(last.values())
            # Shortest: both ends matter, so the left end has to move on with every new match.
            if len(last) == len(lists) and left > best and place - left < within:
                found.add((doc, left - first, place + 1 - first))
                best = left
    return [{"doc_id": block.ids[d], "item_id": item_id, "begin": b, "end": e}
            for d, b, e in sorted(found)]


def remove_contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Rows of ``docs`` whose text holds no window of any item.

    Rows are told apart by a 64-bit hash of the text, so repeated and null ids do no harm.
    """
    index = build_index(docs.select(F.xxhash64("text").alias("key"), "text"), "key")
    hit = find_phrases(index, items, window).where("n_hit > 0").select("doc_id").distinct()
    return docs.join(hit, F.xxhash64(docs["text"]) == hit["doc_id"], "left_anti")


def contamination_report(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per row of ``docs``: words, words hit, items found and their digest."""
    found = find_phrases(build_index(docs), items, window)
    listed = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", listed), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )
