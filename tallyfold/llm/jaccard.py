"""Operator 8: n-gram Jaccard join by a blocked sparse product of document by n-gram incidence.

1. Each task turns its documents into sets of 64-bit shingle hashes. Equal sets are one class, known by a hash of
   the set; a task stores a class's set once. Sets stay in the shared folder.
2. The n-grams most often repeated are counted over all documents. They come last in a global order of n-grams, the
   others in order of hash; any order gives the same links, this one keeps columns of common n-grams out of the product.
3. With n n-grams, a document lacks at most n // 5 of any document that it links with. Only its first n // 5 + 1 + n // 10
   n-grams in the order enter the product, its prefix. Two documents of sizes m and n that link have at least
   o = ceil(4 (m + n) / 9) n-grams in common, of which both prefixes hold at least needed(m, n).
4. Each block of columns multiplies its narrow columns, of up to NARROW documents: overlap counts of pairs of fitting
   size, which add up over the blocks. A pair goes on if its count, with the wide columns that both might share, reaches needed(m, n).
   Pairs in wide columns are never listed: a document with enough wide columns is joined with the first of each of them.
5. What is left ties documents into candidate groups; all links lie inside them. Documents of a group, in order of size,
   form blocks of rows; each pair of blocks whose sizes can link is one product, with exact overlap counts over whole sets.
   All its links are counted, by class and by how many documents the other class has. Of each component that they make, links to its
   least class are returned with the counts, so a group of m near copies gives m links and m counts, not m * m.
6. Components of those links are the classes' components; a class's counts are summed over its products.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .components import components

WORDS, PERCENT = 5, 80
#: Repeated n-grams that are put last in the order, at most; sent to the executors (16 bytes each).
FREQUENT = 500_000
#: N-grams that a task counts, or deals to blocks of columns, at a time.
CHUNK = 750_000
#: Bytes of an Arrow batch that goes to Python or comes from it: the JVM holds such a batch several times over, outside its heap, for each task.
BATCH_BYTES, PACK_BYTES = 1 << 20, 256 << 10
#: Entries in one row of packed columns: each has a gram and a place (12 bytes), and at most a class and a size (16).
PACK_ENTRIES = PACK_BYTES // 28
#: Entries of the product in one block of columns, about.
COLUMN_ENTRIES = 500_000
#: Documents of a column whose pairs are listed, at most. A frequent n-gram in so many sets is wide without a look at its column.
NARROW, SURELY_WIDE = 16, 5_000
#: Documents in a block of rows, and n-grams of all of them.
ROWS, GRAMS = 1_536, 768_000

_mult = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]
_upper = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def _finish(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _in_arrow(df: DataFrame, work, schema) -> DataFrame:
    return common.in_arrow(df, work, schema, "jaccard", BATCH_BYTES)


def shingles(text: bytes, known: dict) -> np.ndarray:
    """Sorted distinct hashes of the runs of WORDS words; of all words together if they are fewer; none without words."""
    words = text.translate(_upper).split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    k = min(WORDS, len(words))
    code = np.full(len(words) - k + 1, k, np.uint64)
    for i in range(k):
        code += h[i : i + len(code)] * _mult[i]
    return np.unique(_finish(code))


def prefix(n: np.ndarray | int):
    return n // 5 + 1 + n // 10


def needed(m: np.ndarray, n: np.ndarray) -> np.ndarray:
    """What the prefixes of linked documents of m and n n-grams share at least.

    The k-th n-gram in common, in the order, comes after at most m - o others in the one document and n - o in the
    other, so it lies in both prefixes for every k up to this.
    """
    o = (4 * (m + n) + 8) // 9
    return np.minimum(prefix(m) - m + o, prefix(n) - n + o)


def sets(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, n, class, grams (the sorted hashes' bytes, at the class's first document in a task, else null); stored."""
    src = common.texts(df, id_col, text_col)
    schema = common.with_id(src, id_col, "n long, class long, grams binary")
    out = common.arrow_schema(schema)

    def work(batches):
        known, seen = _Words(), set()
        for b in batches:
            n, cls, grams, size, start = [], [], [], 0, 0
            for i, text in enumerate(common.utf8(b.column(1))):
                own = shingles(text, known)
                raw = own.tobytes()
                key = xxhash.xxh3_64_intdigest(raw) - (1 << 63) if len(own) else None
                if n and size + len(raw) > BATCH_BYTES:  # short words make sets larger than their texts
                    yield common.batch_of(out, b.column(0)[start:i], n, pa.array(cls, pa.int64()), pa.array(grams, pa.binary()))
                    n, cls, grams, size, start = [], [], [], 0, i
                n.append(len(own))
                cls.append(key)
                if len(seen) > 500_000:
                    seen.clear()
                grams.append(None if key is None or key in seen else raw)
                size += len(grams[-1] or b"")
                seen.add(key)
            yield common.batch_of(out, b.column(0)[start:], n, pa.array(cls, pa.int64()), pa.array(grams, pa.binary()))

    return common.keep(_in_arrow(src, work, schema), "sets", "none")


def frequent(stored: DataFrame, most: int = FREQUENT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The n-grams most often repeated, by hash, their rank among them (rarest first), and whether they are surely wide."""

    def count(batches):
        held, size = [], 0

        def flush():
            grams, n = np.unique(np.concatenate(held), return_counts=True)
            grams, n = grams[n > 1].view(np.int64), n[n > 1]
            for i in range(0, len(grams), BATCH_BYTES // 16):
                yield pa.RecordBatch.from_arrays([pa.array(x[i : i + BATCH_BYTES // 16]) for x in (grams, n)], names=["gram", "n"])

        for b in batches:
            for raw in b.column(0).to_pylist():
                held.append(np.frombuffer(raw, np.uint64))
                size += len(held[-1])
                if size > CHUNK:
                    yield from flush()
                    held, size = [], 0
        if held:
            yield from flush()

    found = _in_arrow(stored.select("grams").filter("grams is not null"), count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).filter("n >= 8").orderBy(F.desc("n"), "gram").limit(most).toPandas()
    grams, n = found["gram"].to_numpy(np.int64).view(np.uint64), found["n"].to_numpy(np.int64)
    by_count = np.lexsort((grams, n))
    rank = np.empty(len(grams), np.int32)
    rank[by_count] = np.arange(len(grams), dtype=np.int32)
    order = np.argsort(grams)
    return grams[order], rank[order], n[order] >= SURELY_WIDE


def columns(stored: DataFrame, hot: tuple[np.ndarray, np.ndarray, np.ndarray], blocks: int) -> DataFrame:
    """block, grams, classes, places, sizes: each task's part of each block of columns, packed. Entries of surely wide columns are
    dealt to the blocks from -blocks to -1 by their class, so that no task gets such a column whole."""
    sent = stored.sparkSession.sparkContext.broadcast(hot)

    def work(batches):
        grams_hot, rank, surely = sent.value
        held: list[np.ndarray] = []
        wide: list[np.ndarray] = []
        keys: list[int] = []
        full: list[int] = []
        total = 0

        def flush():
            size = np.array([len(h) for h in held], np.int64)
            gram = np.concatenate(held)
            owner = np.repeat(np.arange(len(held), dtype=np.uint32), size)
            cls, n = np.array(keys, np.int64), np.array(full, np.int64)
            block = ((gram >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32)).astype(np.int64)
            far = np.concatenate(wide)
            block[far] = -1 - cls[owner[far]] % blocks
            order = np.argsort(block, kind="stable")
            at, ends = np.unique(block[order], return_index=True)
            for k, lo, hi in zip(at.tolist(), ends.tolist(), [*ends[1:].tolist(), len(order)]):
                for i in range(lo, hi, PACK_ENTRIES):
                    own = order[i : min(i + PACK_ENTRIES, hi)]
                    who, place = np.unique(owner[own], return_inverse=True)
                    yield k, gram[own].tobytes(), cls[who].tobytes(), place.astype(np.uint32).tobytes(), n[who].tobytes()

        def packed():
            rows, size = [], 0
            for row in flush():
                if rows and size + sum(map(len, row[1:])) > PACK_BYTES:
                    yield rows
                    rows, size = [], 0
                rows.append(row)
                size += sum(map(len, row[1:]))
            if rows:
                yield rows

        for b in batches:
            for key, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                own = np.frombuffer(raw, np.uint64)
                p = int(prefix(len(own)))
                far = np.zeros(p, bool)
                if len(grams_hot):
                    at = np.minimum(np.searchsorted(grams_hot, own), len(grams_hot) - 1)
                    is_hot = grams_hot[at] == own
                    take = own[~is_hot][:p].copy()
                    if len(take) < p:
                        late = np.flatnonzero(is_hot)
                        late = late[np.argsort(rank[at[late]])][: p - len(take)]
                        far[len(take) :] = surely[at[late]]
                        take = np.concatenate([take, own[late]])
                else:
                    take = own[:p].copy()
                held.append(take)
                wide.append(far)
                keys.append(key)
                full.append(len(own))
                total += p
                if total > CHUNK:
                    yield from map(_packed, packed())
                    held, wide, keys, full, total = [], [], [], [], 0
        if held:
            yield from map(_packed, packed())

    return _in_arrow(stored.select("class", "grams").filter("grams is not null"), work, "block long, grams binary, classes binary, places binary, sizes binary")


def _packed(rows: list[tuple]) -> pa.RecordBatch:
    each = list(zip(*rows))
    return pa.RecordBatch.from_arrays([pa.array(each[0], pa.int64()), *[pa.array(x, pa.binary()) for x in each[1:]]], names=["block", "grams", "classes", "places", "sizes"])


def fitting(gram: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Of entries in order of (gram, n): whether a neighbour has the gram and a size that can link."""
    ok = (gram[1:] == gram[:-1]) & (100 * n[:-1] >= PERCENT * n[1:])
    return np.append(ok, False) | np.append(False, ok)


def shared_columns(packed: DataFrame, blocks: int, narrow: int = NARROW) -> DataFrame:
    """a, b, m, n, shared, gram: of each block of columns, the overlap counts of pairs in its narrow columns (sizes m, n; gram null), and
    the entries of its wide columns (class a of size m in column gram; b null). Columns of one document of fitting size are left out."""

    def entries(held):
        gram = np.concatenate([np.frombuffer(h[0], np.uint64) for h in held])
        cls = np.concatenate([np.frombuffer(h[1], np.int64)[np.frombuffer(h[2], np.uint32)] for h in held])
        n = np.concatenate([np.frombuffer(h[3], np.int64)[np.frombuffer(h[2], np.uint32)] for h in held])
        return gram, cls, n

    def batch(a, b, m, n, shared, gram):
        gone = lambda x, kind: pa.nulls(len(a), kind) if x is None else pa.array(x, kind)
        return pa.RecordBatch.from_arrays([pa.array(a), gone(b, pa.int64()), pa.array(m), gone(n, pa.int64()), gone(shared, pa.int64()), gone(gram, pa.int64())], names=["a", "b", "m", "n", "shared", "gram"])

    def in_parts(*columns):
        most = BATCH_BYTES // 64  # six longs and their marks of nulls
        for i in range(0, len(columns[0]), most):
            yield batch(*[None if c is None else c[i : i + most] for c in columns])

    def flush(block, held):
        if not held:
            return
        gram, cls, n = entries(held)
        if block < 0:
            yield from in_parts(cls, None, n, None, None, gram.view(np.int64))
            return
        order = np.argsort(gram, kind="stable")
        many = gram[order[1:]] == gram[order[:-1]]
        order = order[np.append(many, False) | np.append(False, many)]
        gram, cls, n = gram[order], cls[order], n[order]
        if not len(gram):
            return
        order = np.lexsort((cls, n, gram))
        gram, cls, n = gram[order], cls[order], n[order]
        new = np.append(True, (gram[1:] != gram[:-1]) | (cls[1:] != cls[:-1]))
        gram, cls, n = gram[new], cls[new], n[new]
        ok = fitting(gram, n)
        gram, cls, n = gram[ok], cls[ok], n[ok]
        if not len(gram):
            return
        edge = np.flatnonzero(np.append(True, gram[1:] != gram[:-1]))
        count = np.diff(np.append(edge, len(gram)))
        wide = np.repeat(count > narrow, count)
        if wide.any():
            yield from in_parts(cls[wide], None, n[wide], None, None, gram[wide].view(np.int64))
        left, right = [], []
        for k in range(2, narrow + 1):
            at = edge[count == k][:, None] + np.arange(k)
            i, j = np.triu_indices(k, 1)
            i, j = at[:, i].ravel(), at[:, j].ravel()
            fit = 100 * n[i] >= PERCENT * n[j]  # sizes ascend in a column
            left.append(i[fit])
            right.append(j[fit])
        i, j = np.concatenate(left), np.concatenate(right)
        if not len(i):
            return
        swap = cls[i] > cls[j]
        i, j = np.where(swap, j, i), np.where(swap, i, j)
        order = np.lexsort((cls[j], cls[i]))
        i, j = i[order], j[order]
        first = np.flatnonzero(np.append(True, (cls[i[1:]] != cls[i[:-1]]) | (cls[j[1:]] != cls[j[:-1]])))
        shared = np.diff(np.append(first, len(i)))
        i, j = i[first], j[first]
        yield from in_parts(cls[i], cls[j], n[i], n[j], shared, None)

    def work(batches):
        now, held = None, []
        for b in batches:
            for k, *rest in zip(*[c.to_pylist() for c in b.columns]):
                if k != now:
                    yield from flush(now, held)
                    now, held = k, []
                held.append(rest)
        yield from flush(now, held)

    return _in_arrow(packed.repartition(blocks, "block").sortWithinPartitions("block"), work, "a long, b long, m long, n long, shared long, gram long")


def candidates(found: DataFrame) -> DataFrame:
    """a, b: pairs of classes whose components hold all links; found is shared_columns' table."""
    wide = common.keep(found.filter("b is null").select("gram", F.col("a").alias("class"), F.col("m").alias("n")).distinct(), "wide")
    pairs = found.filter("b is not null").groupBy("a", "b").agg(F.first("m").alias("m"), F.first("n").alias("n"), F.sum("shared").alias("shared"))
    # with o = ceil(4 (m + n) / 9), what both prefixes hold at least
    need = "least(m div 5 + 1 + m div 10 - m, n div 5 + 1 + n div 10 - n) + (4 * (m + n) + 8) div 9"
    some = wide.groupBy("class").agg(F.count(F.lit(1)).alias("wide"))
    sure = pairs.withColumn("need", F.expr(need))
    sure = sure.join(some.select(F.col("class").alias("a"), F.col("wide").alias("wa")), "a", "left").join(some.select(F.col("class").alias("b"), F.col("wide").alias("wb")), "b", "left")
    met = sure.filter("shared + least(coalesce(wa, 0), coalesce(wb, 0)) >= need").select("a", "b")
    for _ in range(2):  # pairs that share wide columns only share as many as the smallest size that links with either needs
        enough = common.keep(wide.groupBy("class").agg(F.count(F.lit(1)).alias("k"), F.max("n").alias("n")).filter("k >= 1 + ((4 * n + 4) div 5) div 10").select("class"), "wide-classes")
        first = common.keep(wide.join(enough, "class").groupBy("gram").agg(F.count(F.lit(1)).alias("k"), F.min("class").alias("least")).filter("k > 1").select("gram", "least"), "wide-columns")
        wide = common.keep(wide.select("gram", "class", "n").join(enough, "class").join(first, "gram").select("gram", "class", "n", "least"), "wide")
    return met.unionByName(wide.select(F.col("class").alias("a"), F.col("least").alias("b")).filter("a <> b").distinct())


def product(sizes: np.ndarray, grams: list[np.ndarray], copies: np.ndarray, split: int | None) -> tuple[np.ndarray, np.ndarray]:
    """For each row of a block of documents, the first row of its component (-1: none), and how many documents it links with.

    Overlaps are exact, of all pairs, or of pairs across `split`; a row stands for `copies` documents.
    """
    m = len(grams)
    left, start = (m, 0) if split is None else (split, split)
    gram = np.concatenate(grams)
    owner = np.repeat(np.arange(m), sizes)
    order = np.argsort(gram, kind="stable")
    gram, owner = gram[order], owner[order]
    edge = np.flatnonzero(np.append(True, gram[1:] != gram[:-1]))
    count = np.diff(np.append(edge, len(gram)))
    overlap = np.zeros((left, m - start), np.float32)  # whole numbers below 2^24 are exact
    found = []
    for k in np.unique(count[(count > 1) & (count < 12)]):  # columns of few documents: their pairs
        rows = owner[edge[count == k][:, None] + np.arange(k)]
        i, j = np.triu_indices(k, 1)
        i, j = rows[:, i].ravel(), rows[:, j].ravel()  # rows ascend: the sort is stable
        if split is not None:
            across = (i < split) & (j >= split)
            i, j = i[across], j[across]
        found.append(i * (m - start) + j - start)
        if split is None:
            found.append(j * m + i)
    if found:
        at, times = np.unique(np.concatenate(found), return_counts=True)
        overlap.ravel()[at] += times
    wide = np.flatnonzero(count >= 12)
    for at in range(0, len(wide), 1024):  # columns of many: a dense product
        part = wide[at : at + 1024]
        a = np.zeros((m, len(part)), np.float32)
        column = np.repeat(np.arange(len(part)), count[part])
        place = np.repeat(edge[part] - np.cumsum(count[part]) + count[part], count[part]) + np.arange(count[part].sum())
        a[owner[place], column] = 1
        overlap += a[:left] @ a[start:].T
    ok = np.zeros(overlap.shape, bool)
    for i in range(0, left, 256):
        both = overlap[i : i + 256].astype(np.int64)
        ok[i : i + 256] = 100 * both >= PERCENT * (sizes[i : min(i + 256, left), None] + sizes[None, start:] - both)
    if split is None:
        np.fill_diagonal(ok, False)
    met = np.zeros(m, np.int64)
    met[:left] += ok @ copies[start:]
    if split is not None:
        met[start:] += ok.T @ copies[:left]
    first = np.full(m, -1, np.int64)
    for i in np.flatnonzero(met).tolist():
        if first[i] >= 0:
            continue
        first[i], new = i, np.array([i])
        while len(new):
            seen = np.zeros(m, bool)
            seen[start:] |= ok[new[new < left]].any(axis=0)
            if split is not None:
                seen[:left] |= ok[:, new[new >= start] - start].any(axis=1)
            new = np.flatnonzero(seen & (first < 0))
            first[new] = i
    return first, met


def links(stored: DataFrame, column_entries: int = COLUMN_ENTRIES, rows: int = ROWS, most_frequent: int = FREQUENT, narrow: int = NARROW, grams: int = GRAMS) -> DataFrame:
    """a, b, met: links between classes whose components are those of all links, with null met; and, with null b, how many
    documents of other classes each document of class a links with, in parts that add up to all."""
    entries = stored.filter("grams is not null").agg(F.sum(prefix_column())).head()[0] or 0
    blocks = max(1, -(-entries // column_entries))
    found = common.keep(shared_columns(columns(stored, frequent(stored, most_frequent), blocks), blocks, narrow), "overlaps")
    close = common.keep(candidates(found), "candidates")
    sizes = found.select(F.col("a").alias("class"), F.col("m").alias("n")).union(found.filter("b is not null").select("b", "n")).distinct()
    group = common.keep(components(close, "candidates").withColumnRenamed("node", "class").join(sizes, "class"), "groups")
    common.drop(found)
    common.settle(stored.sparkSession)  # the columns' shuffle files go before sets are dealt out
    count = group.count()
    if not count:
        return close.select("a", "b", F.lit(None).cast("long").alias("met")).limit(0)
    # a large group is cut into bands of like size, and a band with too many documents or n-grams is dealt by hash
    fits = (F.col("size") <= rows) & (F.col("weight") <= grams)
    total = group.groupBy("root").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("weight"), F.percentile_approx("n", F.array(*[F.lit(x / 64) for x in range(1, 64)]), F.lit(1000)).alias("q"))
    total = common.keep(total.withColumn("whole", fits).withColumn("parts", F.least(F.lit(64), F.greatest(F.ceil(F.col("size") / rows), F.ceil(F.col("weight") / grams))).cast("int")).withColumn("q", F.when(~fits, F.col("q"))), "shapes")
    small = group.join(total.filter("whole").select("root"), "root").select("class", "root", _no_block().alias("x"), _no_block().alias("y"), F.lit(True).alias("first"))
    banded = group.join(total.filter("not whole"), "root").select("class", "root", "n", F.expr("size(filter(q, x -> x < n)) * parts div 64").cast("int").alias("band"))
    dealt = common.keep(banded.groupBy("root", "band").agg(F.greatest(F.ceil(F.count(F.lit(1)) / rows), F.ceil(F.sum("n") / grams)).alias("deals")), "bands")
    member = common.keep(banded.join(dealt, ["root", "band"]).select("class", "root", "n", F.struct("band", F.pmod(F.xxhash64("class"), F.col("deals")).alias("deal")).alias("block")), "members")
    many = common.keep(member.groupBy("root", "block").agg(F.min("n").alias("low"), F.max("n").alias("high")), "blocks")
    a, b = many.alias("a"), many.alias("b")
    pairs = a.join(b, (F.col("a.root") == F.col("b.root")) & (F.col("a.block") <= F.col("b.block"))).filter(f"100 * a.high >= {PERCENT} * b.low and 100 * b.high >= {PERCENT} * a.low").select(F.col("a.root").alias("root"), F.col("a.block").alias("x"), F.col("b.block").alias("y"))
    twice = pairs.select("root", "x", "y", F.explode(F.array_distinct(F.array("x", "y"))).alias("block"))
    jobs = member.join(twice, ["root", "block"]).select("class", "root", "x", "y", (F.col("block") == F.col("x")).alias("first")).unionByName(small)
    active = stored.sparkSession.sparkContext.broadcast(common.bloom(group, "class", count))

    def pick(batches):
        for x in batches:
            yield x.filter(pa.array(active.value.has(x.column(0).to_numpy(zero_copy_only=False).view(np.uint64))))

    whole = _in_arrow(stored.select("class", "grams").filter("class is not null"), pick, "class long, grams binary").groupBy("class").agg(F.first("grams", ignorenulls=True).alias("grams"), F.count(F.lit(1)).alias("copies"))

    def multiply(table: pa.Table) -> pa.Table:
        x, y = table.column("x")[0].as_py(), table.column("y")[0].as_py()
        first = table.column("first").to_numpy()
        order = np.lexsort((table.column("class").to_numpy(), ~first))
        names = table.column("class").to_numpy()[order]
        raw = table.column("grams").to_pylist()
        own = [np.frombuffer(raw[i], np.uint64) for i in order]
        root, met = product(np.array([len(g) for g in own]), own, table.column("copies").to_numpy()[order], int(first.sum()) if x != y else None)
        tied, some = np.flatnonzero((root >= 0) & (root != np.arange(len(root)))), np.flatnonzero(met)
        none = pa.nulls
        return pa.table({
            "a": pa.array(np.concatenate([names[tied], names[some]]), pa.int64()),
            "b": pa.chunked_array([pa.array(names[root[tied]], pa.int64()), none(len(some), pa.int64())], pa.int64()),
            "met": pa.chunked_array([none(len(tied), pa.int64()), pa.array(met[some], pa.int64())], pa.int64()),
        })

    return common.groups_in_arrow(jobs.join(whole, "class").groupBy("root", "x", "y"), multiply, "a long, b long, met long", "jaccard")


def _no_block() -> F.Column:
    return F.struct(F.lit(-1).alias("band"), F.lit(0).cast("long").alias("deal"))


def prefix_column() -> F.Column:
    return F.expr("n div 5 + 1 + n div 10")


def join(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **bounds: int) -> DataFrame:
    """id_col, n_shingles, class, n_links, component_id: every document with the number of those it links with, and the least id of those it reaches.

    Words are runs without x20 and x09 to x0D, A-Z in lower case; shingles are runs of five words, or all words of a
    shorter text. Two documents link when 100 * intersection >= 80 * union. Null and empty texts have no shingle, no
    class, no link, and their own id. Rows of equal sets are of one class, and each links with all others of it. Null ids are passed over as least id, unless a component
    has no other.
    """
    stored = sets(df, id_col, text_col)
    found = common.keep(links(stored, **bounds), "products")
    roots = components(found.select("a", "b"), "links")
    met = found.filter("met is not null").groupBy(F.col("a").alias("class")).agg(F.sum("met").alias("met"))
    ids = stored.filter("class is not null").groupBy("class").agg(F.min(id_col).alias("least"), F.count(F.lit(1)).alias("copies"))
    rooted = ids.join(roots.withColumnRenamed("node", "class"), "class", "left").withColumn("root", F.coalesce("root", "class"))
    rooted = rooted.join(met, "class", "left").withColumn("n_links", F.col("copies") - 1 + F.coalesce("met", F.lit(0)))
    rooted = common.keep(rooted, "rooted")
    best = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    final = rooted.select("class", "root", "n_links").join(best, "root").select("class", "n_links", "component_id")
    out = stored.select(id_col, "n", "class").join(final, "class", "left")
    return out.select(F.col(id_col), F.col("n").alias("n_shingles"), "class", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.when(F.col("class").isNull(), F.col(id_col)).otherwise(F.col("component_id")).alias("component_id"))
