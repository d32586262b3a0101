"""Operator 4: benchmark decontamination by a distributed positional inverted index."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

WINDOW = 10
#: Benchmark texts are matched in blocks of at most so many characters, one block after another; more text is more blocks.
BLOCK_CHARS = 16_000_000
#: A shard of the index covers about so many characters of documents, and one document at least.
SHARD_CHARS = 4_000_000

_own = bytes(range(0x30, 0x3A)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100))
#: A-Z to lower case; what is no word byte to a blank.
_to = bytes(b if b in _own else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))

INDEX = "shard long, n_words binary, terms binary, term_ends binary, places binary"


class _Terms(dict):
    """The number of each word: its 64-bit hash."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def words(text: bytes) -> list[bytes]:
    """Words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of UTF-8 text after lower-casing A-Z: all bytes of other characters belong to words."""
    return text.translate(_to).split()


@dataclass
class Block:
    """Windows of some benchmark items, as places of their terms in `terms`, which ascend; -1 fills the windows of short items."""

    items: list
    terms: np.ndarray
    windows: np.ndarray
    owner: np.ndarray  # item of each window
    length: np.ndarray
    order: np.ndarray | None = None  # places in each window, the rarest term first

    @staticmethod
    def of(rows: Iterable[tuple[object, str | None]], window: int) -> Block:
        known = _Terms()
        items, texts, lengths = [], [], []
        for item, text in rows:
            own = [known[w] for w in words((text or "").encode())]
            if own:
                items.append(item)
                texts.append(np.array(own, np.uint64))
                lengths.append(min(window, len(own)))
        terms = np.unique(np.concatenate([*texts, np.zeros(0, np.uint64)]))
        found = [np.zeros((0, window), np.int32)]
        for text, n in zip(texts, lengths):
            at = np.searchsorted(terms, text).astype(np.int32)
            full = np.full((len(at) - n + 1, window), -1, np.int32)
            full[:, :n] = np.lib.stride_tricks.sliding_window_view(at, n)
            found.append(full)
        count = [len(f) for f in found[1:]]
        return Block(items, terms, np.concatenate(found), np.repeat(np.arange(len(items)), count), np.repeat(np.array(lengths, np.int64), count))

    def rank(self, seen: np.ndarray) -> None:
        """seen: how often the training corpus has each term."""
        count = np.append(seen, np.iinfo(np.int64).max)[self.windows]  # -1 is last
        self.order = np.argsort(count, axis=1, kind="stable").astype(np.int8)


def blocks(benchmark: DataFrame, item_col: str, text_col: str, window: int, chars: int = BLOCK_CHARS) -> Iterator[Block]:
    """The benchmark in blocks of at most `chars` characters (one item at least); the driver holds one at a time."""
    rows, size = [], 0
    for r in benchmark.select(F.col(item_col), F.col(text_col).cast("string")).toLocalIterator():
        if rows and size + len(r[1] or "") > chars:
            yield Block.of(rows, window)
            rows, size = [], 0
        rows.append((r[0], r[1]))
        size += len(r[1] or "")
    if rows:
        yield Block.of(rows, window)


def index(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_chars: int = SHARD_CHARS) -> DataFrame:
    """Positional postings of every training token: a row for each shard, stored in the shared folder. It depends on no benchmark.

    A shard holds consecutive documents of one task, laid end to end: `ids` and n_words of each, its terms (word hashes, ascending),
    and for each term the places of its tokens, ascending; term_ends are the lists' ends.
    """
    src = common.texts(df, id_col, text_col)
    schema = common.T.StructType.fromDDL(INDEX).add("ids", common.T.ArrayType(src.schema[id_col].dataType))
    out = common.arrow_schema(schema)

    def shard(number: int, ids: list, sizes: list[int], terms: list[np.ndarray]) -> pa.RecordBatch:
        own = np.concatenate(terms)
        order = np.argsort(own, kind="stable").astype(np.int32)
        own = own[order]
        ends = np.flatnonzero(np.append(own[1:] != own[:-1], True)).astype(np.int32) + 1 if len(own) else np.zeros(0, np.int32)
        return common.batch_of(out, [number], *[pa.array([x.tobytes()], pa.binary()) for x in (np.array(sizes, np.int64), own[ends - 1], ends, order)], pa.array([ids], out.field("ids").type))

    def work(batches):
        from pyspark import TaskContext

        known = _Terms()
        number, ids, sizes, terms, size = TaskContext.get().partitionId() << 32, [], [], [], 0
        for b in batches:
            for i, text in zip(b.column(0).to_pylist(), common.utf8(b.column(1))):
                own = words(text)
                ids.append(i)
                sizes.append(len(own))
                terms.append(np.fromiter(map(known.__getitem__, own), np.uint64, len(own)))
                size += len(text)
                if size >= shard_chars:
                    yield shard(number, ids, sizes, terms)
                    number, ids, sizes, terms, size = number + 1, [], [], [], 0
        if ids:
            yield shard(number, ids, sizes, terms)

    return common.keep(common.in_arrow(src, work, schema, "decontamination"), "postings")


class Shard:
    """A row of the index, opened."""

    def __init__(self, b: pa.RecordBatch, row: int):
        get = lambda name, kind: np.frombuffer(b.column(b.schema.get_field_index(name))[row].as_py(), kind)
        self.number = b.column(b.schema.get_field_index("shard"))[row].as_py()
        self.n_words, self.terms, self.places = get("n_words", np.int64), get("terms", np.uint64), get("places", np.int32)
        self.ends = get("term_ends", np.int32).astype(np.int64)
        self.base = np.concatenate([[0], np.cumsum(self.n_words)])  # first place of each document

    def lists(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number, begin and length of each term's list of places; -1 and length 0 where the shard lacks it."""
        at = np.minimum(np.searchsorted(self.terms, terms), max(0, len(self.terms) - 1))
        if not len(self.terms):
            none = np.zeros(len(terms), np.int64)
            return none - 1, none, none
        have = self.terms[at] == terms
        begin = np.where(at > 0, self.ends[at - 1], 0)
        return np.where(have, at, -1), begin, np.where(have, self.ends[at] - begin, 0)

    def documents(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.base, places, side="right") - 1

    def intersect(self, block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window, start in the document, document) of every occurrence: the places of each window's rarest term, less its offset in the
        window, are met with those of the next rarest, less that one's offset, and so on."""
        number, begin, size = self.lists(block.terms)
        w = np.arange(len(block.windows))
        live = np.ones(len(w), bool)
        for k in range(block.windows.shape[1]):  # a window of which a shard lacks a term has no occurrence there
            t = block.windows[:, k]
            live &= (t < 0) | (size[t] > 0)
        w = w[live]
        first = block.order[w, 0].astype(np.int64)
        anchor = block.windows[w, first]
        n = size[anchor]
        window = np.repeat(w, n)
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        start = self.places[np.repeat(begin[anchor], n) + within] - np.repeat(first, n)
        # all lists end to end ascend by (term, place): a place is in a term's list if their pair is among them
        span = int(self.base[-1]) + 1
        pairs = np.repeat(np.arange(len(self.terms)), np.diff(self.ends, prepend=0)) * span + self.places if len(window) else np.zeros(0, np.int64)
        doc = self.documents(np.maximum(start, 0))
        ok = (start >= self.base[doc]) & (start + block.length[window] <= self.base[doc + 1])
        window, start, doc = window[ok], start[ok], doc[ok]
        for k in range(1, block.windows.shape[1]):
            if not len(window):
                break
            offset = block.order[window, k].astype(np.int64)
            term = block.windows[window, offset]
            wanted = number[term] * span + start + offset
            met = (term < 0) | (pairs[np.minimum(np.searchsorted(pairs, wanted), len(pairs) - 1)] == wanted)
            window, start, doc = window[met], start[met], doc[met]
        return window, start - self.base[doc], doc


def _counts(stored: DataFrame, terms: np.ndarray) -> np.ndarray:
    """How often the indexed corpus has each of some terms: a sum on the executors, at most one row for each term comes back."""
    sent = stored.sparkSession.sparkContext.broadcast(terms)

    def work(batches):
        for b in batches:
            for row in range(b.num_rows):
                get = lambda name, kind, b=b, row=row: np.frombuffer(b.column(b.schema.get_field_index(name))[row].as_py(), kind)
                own, ends = get("terms", np.uint64), get("term_ends", np.int32).astype(np.int64)
                if len(own):
                    at = np.minimum(np.searchsorted(own, sent.value), len(own) - 1)
                    have = np.flatnonzero(own[at] == sent.value)
                    yield pa.RecordBatch.from_arrays([pa.array(have), pa.array(np.diff(ends, prepend=0)[at[have]])], names=["term", "n"])

    out = np.zeros(len(terms), np.int64)
    for r in common.in_arrow(stored.select("terms", "term_ends"), work, "term long, n long", "decontamination").groupBy("term").agg(F.sum("n").alias("n")).toLocalIterator():
        out[r["term"]] = r["n"]
    sent.destroy()
    return out


def documents(stored: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """__shard, __ordinal, id_col, n_words of every indexed document."""
    id_type = stored.schema["ids"].dataType.elementType
    schema = common.T.StructType([common.T.StructField("__shard", common.T.LongType()), common.T.StructField("__ordinal", common.T.IntegerType()), common.T.StructField(id_col, id_type), common.T.StructField("n_words", common.T.LongType())])
    out = common.arrow_schema(schema)

    def work(batches):
        for b in batches:
            for row in range(b.num_rows):
                n = np.frombuffer(b.column(1)[row].as_py(), np.int64)
                yield common.batch_of(out, np.full(len(n), b.column(0)[row].as_py()), np.arange(len(n), dtype=np.int32), b.column(2)[row].values, n)

    return common.in_arrow(stored.select("shard", "n_words", "ids"), work, schema, "decontamination")


def occurrences(stored: DataFrame, block: Block, item_type: str = "string") -> DataFrame:
    """__shard, __ordinal, hits array<struct<start, end>>, items: of documents in which a window of the block occurs; stored.

    Shards are matched where they lie. The block is sent to the executors for this, and dropped after it.
    """
    block.rank(_counts(stored, block.terms))
    sent = stored.sparkSession.sparkContext.broadcast(block)
    schema = common.T.StructType.fromDDL(f"__shard long, __ordinal int, hits array<struct<start:int,end:int>>, items array<{item_type}>")
    out = common.arrow_schema(schema)

    def work(batches):
        for b in batches:
            for row in range(b.num_rows):
                own, shard = sent.value, Shard(b, row)
                window, start, doc = shard.intersect(own)
                order = np.argsort(doc, kind="stable")
                window, start, doc = window[order], start[order], doc[order]
                each, cuts = np.unique(doc, return_index=True)
                hits, items = [], []
                for lo, hi in zip(cuts, [*cuts[1:], len(doc)]):
                    hits.append([{"start": s, "end": e} for s, e in union(list(zip(start[lo:hi].tolist(), (start[lo:hi] + own.length[window[lo:hi]]).tolist())))])
                    items.append([own.items[i] for i in np.unique(own.owner[window[lo:hi]]).tolist()])
                yield common.batch_of(out, np.full(len(each), shard.number), each.astype(np.int32), pa.array(hits, out.field("hits").type), pa.array(items, out.field("items").type))

    found = common.keep(common.in_arrow(stored.drop("ids"), work, schema, "decontamination"), "occurrences")
    sent.destroy()
    return found


#: Documents with hits that are sent to all executors, at most; more meet the others by shuffle.
BROADCAST_HITS = 200_000


def matches(stored: DataFrame, parts: Iterable[Block], id_col: str = "doc_id", item_type: str = "string") -> DataFrame:
    """id_col, n_words, hits array<struct<start, end>>, items: for every indexed document, the union of the word runs that windows cover, and the items they are of.

    Blocks are matched one after another, and what they find meets by document.
    """
    found = reduce(DataFrame.unionByName, [occurrences(stored, b, item_type) for b in parts], stored.sparkSession.createDataFrame([], f"__shard long, __ordinal int, hits array<struct<start:int,end:int>>, items array<{item_type}>"))
    merged = "aggregate(array_sort(hits), array(named_struct('start', -1, 'end', -1)), (a, x) -> if(x.start <= element_at(a, -1).end, concat(slice(a, 1, size(a) - 1), array(named_struct('start', element_at(a, -1).start, 'end', greatest(element_at(a, -1).end, x.end)))), concat(a, array(x))), a -> slice(a, 2, greatest(size(a) - 1, 0)))"
    both = found.groupBy("__shard", "__ordinal").agg(F.flatten(F.collect_list("hits")).alias("hits"), F.flatten(F.collect_list("items")).alias("items")).withColumn("hits", F.when(F.size("hits") > 1, F.expr(merged)).otherwise(F.col("hits")))
    if found.count() <= BROADCAST_HITS:
        both = F.broadcast(both)
    none = lambda kind: F.array().cast(kind)
    out = documents(stored, id_col).join(both, ["__shard", "__ordinal"], "left")
    return out.select(id_col, "n_words", F.coalesce("hits", none("array<struct<start:int,end:int>>")).alias("hits"), F.coalesce("items", none(f"array<{item_type}>")).alias("items"))


def union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping and touching runs joined."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def phrases(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, block_chars: int = BLOCK_CHARS, shard_chars: int = SHARD_CHARS) -> DataFrame:
    """Exact phrase matches of benchmark windows in every whole document; see matches() for the columns.

    Null and empty texts have no words, no hits and no items; an item without words has no window; an empty
    benchmark hits nothing. Equal items all count. Repeated document rows are matched each. Words are compared by 64-bit hashes.
    """
    return matches(index(df, id_col, text_col, shard_chars), blocks(benchmark, item_col, item_text, window, block_chars), id_col, benchmark.schema[item_col].dataType.simpleString())


def proximity(stored: DataFrame, queries: list[str], within: int, id_col: str = "doc_id") -> DataFrame:
    """Where all words of a query lie within `within` consecutive words of a document, in any order: id_col, query int, start, end (words).

    stored is an index(), of any documents. Of the smallest such stretches, each that begins no other is returned. The query list is the
    caller's, so small. Lists are met from the shortest on.
    """
    known = _Terms()
    wanted = [np.array(sorted({known[w] for w in words(q.encode())}), np.uint64) for q in queries]
    schema = common.T.StructType([common.T.StructField(id_col, stored.schema["ids"].dataType.elementType)])
    for f in common.T.StructType.fromDDL("query int, start int, end int").fields:
        schema = schema.add(f)
    out = common.arrow_schema(schema)

    def work(batches):
        for b in batches:
            for row in range(b.num_rows):
                shard, ids, found = Shard(b, row), b.column(b.schema.get_field_index("ids"))[row].as_py(), []
                for q, terms in enumerate(wanted):
                    _, begin, size = shard.lists(terms)
                    if not len(terms) or not size.all():
                        continue
                    places = [shard.places[begin[t] : begin[t] + size[t]] for t in np.argsort(size)]
                    docs = np.unique(shard.documents(places[0]))
                    for p in places[1:]:
                        docs = docs[np.isin(docs, shard.documents(p))]
                    spots = sorted((int(p), t) for t, own in enumerate(places) for p in own[np.isin(shard.documents(own), docs)])
                    for d in docs.tolist():
                        lo, hi = shard.base[d], shard.base[d + 1]
                        found += [(ids[d], q, s, e) for s, e in stretches([(int(p - lo), t) for p, t in spots if lo <= p < hi], len(terms), within)]
                yield common.batch_of(out, pa.array([f[0] for f in found], out.field(0).type), [f[1] for f in found], [f[2] for f in found], [f[3] for f in found])

    return common.in_arrow(stored, work, schema, "decontamination")


def stretches(spots: list[tuple[int, int]], terms: int, within: int) -> list[tuple[int, int]]:
    """Smallest stretches with all terms, by a sliding count."""
    out, count, lo = [], {}, 0
    for p, t in spots:
        count[t] = count.get(t, 0) + 1
        while len(count) == terms:
            s, u = spots[lo]
            if p - s < within and count[u] == 1:
                out.append((s, p + 1))
            count[u] -= 1
            if not count[u]:
                del count[u]
            lo += 1
    return out
