"""Operators 11 to 13 against brute force and SQL, and their edge cases."""

import hashlib
import itertools
import random
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyfold.llm import common, filters, packing, queries, trie

P = pytest.importorskip("public_tokenizers")
PATH = P.path("byte_bpe_50k.json")


def turns(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"depth": F.lit("clash"), "level": F.lit(1), "h1": F.lit(None).cast("string"), "pos": F.lit(0), "at": F.lit(0)})


def brute_trie(rows):
    own = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, r or "", x or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = own.get(c - c % 100, [])[:h] + own[c][h:]
    members = defaultdict(list)
    for c, said in built.items():
        for d in range(len(said) + 1):
            members[tuple(said[:d])].append(c)
    kids = defaultdict(list)
    for k in members:
        if k:
            kids[k[:-1]].append(k)

    leaves, saved = {}, {}
    for k in sorted(members, key=len, reverse=True):
        leaves[k] = sum(leaves[x] for x in kids[k]) or 1
        saved[k] = sum(saved[x] for x in kids[k]) + ((len(members[k]) - 1) * len(k[-1][1]) if k else 0)
    sha = lambda ids: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    return sorted((min(m), len(k), min(members[k[:-1]]) if k else -1, len(m), len(kids[k]), leaves[k], saved[k], sha(c for c in m if len(built[c]) == len(k))) for k, m in members.items())


def got_trie(df):
    assert df.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(tuple(-1 if x is None else x for x in r) for r in df.collect())


def logs(seed, n=60):
    """Conversations that share turns of several families, with copies, turnless ones, nulls and ties."""
    rng, rows = random.Random(seed), []
    for c in rng.sample(range(0, 450), n) + [0, 100]:
        for t in range(rng.choice([1, 2, 3, 5, 8, 12])):
            rows.append((c, rng.choice([t, t, t, None, 3]), rng.choice(["user", "bot", None, ""]), rng.choice(["a", "bé", None, "", "ccc 😀"])))
    return rows + rows[:5] + [(None, 0, "user", "lost"), (403, 0, "user", "x" * 50_000)]


@pytest.mark.parametrize("seed", range(2))
def test_trie_equals_brute_force_and_sql(spark, seed):
    rows = logs(seed)
    found = got_trie(trie.prefix_trie(turns(spark, rows)))
    assert found == brute_trie(rows)
    with duckdb.connect() as db:
        db.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
        db.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
        said = db.sql(queries.SQL["op11_conversation_trie"])
        at = [said.columns.index(c) for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")]
        assert sorted(tuple(-1 if r[i] is None else r[i] for i in at) for r in said.fetchall()) == found


def test_trie_of_long_paths_and_many_equal_ends(spark, monkeypatch):
    """Paths longer than a block, ends longer than a chunk, one conversation of most rows, light edges below one another."""
    monkeypatch.setattr(trie, "BLOCK", 7)
    monkeypatch.setattr(trie, "CHUNK", 3)
    rows = [(c, t, "user", str(t)) for c in (5, 100, 107, 200, *range(301, 330)) for t in range(9)] + [(100, t, "bot", f"long {t // 3}") for t in range(9, 90)]
    rows += [(400 + i, t, "user", f"{i >> min(t, 3)}") for i in range(16) for t in range(6)]
    assert got_trie(trie.prefix_trie(turns(spark, rows))) == brute_trie(rows)


def test_levels_of_the_trie_are_logarithmic(spark):
    """Each level of light edges at least halves the members; every node is on one path."""
    rows = [(1000 + i, t, "u", str(i >> t)) for i in range(64) for t in range(7)]
    convs, built = trie.rebuild(turns(spark, rows))
    rolled = trie.running(built, "conv_id", "pos", {"g1": "h1", "g2": "h2"}, F.bit_xor, lambda a, b: a.bitwiseXOR(b), 7)
    prefixes = rolled.select("conv_id", "pos", "h1", "h2", F.col("h1").bitwiseXOR(F.col("g1")).alias("q1"), F.col("h2").bitwiseXOR(F.col("g2")).alias("q2"), "chars")
    tree, paths = trie.decompose(convs, prefixes, None)
    assert paths.agg(F.max("level")).first()[0] <= 6
    assert paths.count() == paths.select("depth", "h1", "h2").distinct().count() == tree.count()


def test_trie_of_nothing_and_of_turnless_conversations(spark):
    assert got_trie(trie.prefix_trie(turns(spark, [(1, 0, "u", "x")]).filter("false"))) == []
    c = next(c for c in range(201, 300) if zlib.crc32(str(c).encode()) % 6 > 1)
    assert got_trie(trie.prefix_trie(turns(spark, [(c, 0, "u", "gone")]))) == brute_trie([(c, 0, "u", "gone")]) == [(c, 0, -1, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]


def documents(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"part": F.lit("clash"), "mask": F.lit(0), "id": F.lit("x"), "n": F.lit(1), "good": F.lit("no"), "step": F.lit(0)})


def brute_audit(rows, labels):
    good, toxic = {d for d, q, _ in labels if q == 1 and d is not None}, {d for d, _, t in labels if t == 1 and d is not None}
    least = {}
    for d, x, _ in rows:
        if d is not None:
            least[x or ""] = min(d, least.get(x or "", d))
    blanks = "\t\n\x0b\x0c\r"
    own = []
    for d, x, s in rows:
        x = x or ""
        w = [y for y in x.translate(str.maketrans(blanks, " " * 5)).split(" ") if y]
        fails = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * sum("A" <= y <= "Z" for y in x) > 5 * len(x), "D": any(y in "#$%&*|" for y in x), "E": d is not None and least[x] < d}
        own.append((s or "", {k for k, v in fails.items() if v}, d in good, d in toxic))
    out = {}
    for part in {x[0] for x in own}:
        mine, shapley = [x for x in own if x[0] == part], defaultdict(int)
        for order in map("".join, itertools.permutations("ABCDE")):
            for i, f in enumerate(order):
                before = set(order[:i])
                removed = [x for x in mine if f in x[1] and not x[1] & before]
                shapley[f] += len(removed)
                out[part, order, i + 1] = [sum(not x[1] & (before | {f}) for x in mine), len(removed), sum(f in x[1] and bool(x[1] & before) for x in mine), sum(x[1] == {f} for x in mine), sum(x[2] for x in removed), sum(x[3] for x in removed)]
        for (p, order, i), v in out.items():
            if p == part:
                v.append(shapley[order[i - 1]])
    return {k: tuple(v) for k, v in out.items()}


def audit_rows():
    rng = random.Random(5)
    words = lambda n, m: " ".join(rng.choice(["lorem", "Ipsum", "dolor", "sit", "a#b", "é", "x\x85y", "AB", "100%"][:m] + [str(rng.random())]) for _ in range(n))
    texts = [words(rng.choice([0, 3, 49, 50, 51, 70]), rng.choice([1, 3, 5, 9])) for _ in range(40)] + [None, "", " \t\n", "A", " ".join(f"w{i}" for i in range(50)), "long word " * 30_000, " ".join([f"w{i}" for i in range(65)] + ["w0"] * 35), "B" * 5 + "b" * 95, "B" * 6 + "b" * 94]
    rows = [(i, t, rng.choice(["a", "b", None, ""])) for i, t in enumerate(texts)]
    rows += [(100 + i, rng.choice(texts), rng.choice(["a", "c"])) for i in range(40)] + [(3, texts[3], "b"), (3, texts[3], "a"), rows[7], (None, texts[2], "a"), (None, texts[2], "a"), (None, "only null", "d")]
    labels = [(d, rng.choice([0, 1, None]), rng.choice([0, 1])) for d in range(0, 140, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1), (999, 1, 1)]
    return rows, labels


def test_audit_equals_brute_force_and_sql(spark):
    rows, labels = audit_rows()
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("id", F.lit("clash"))
    found = filters.audit(documents(spark, rows), marks)
    assert found.columns == ["part", "filter_order", "step", *filters.METRICS]
    mine = {tuple(r[:3]): tuple(r[3:]) for r in found.collect()}
    assert mine == brute_audit(rows, labels)
    with duckdb.connect() as db:
        db.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR); CREATE TABLE labels (doc_id BIGINT, quality INT, toxic INT)")
        db.executemany("INSERT INTO documents VALUES (?, ?, ?)", rows)
        db.executemany("INSERT INTO labels VALUES (?, ?, ?)", labels)
        said = db.sql(queries.SQL["op12_filter_audit"])
        assert said.columns == found.columns
        assert {r[:3]: r[3:] for r in said.fetchall()} == mine


def test_audit_of_nothing_and_without_labels(spark):
    rows, _ = audit_rows()
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filters.audit(documents(spark, rows).filter("false"), none).count() == 0
    assert filters.audit(documents(spark, rows), none).agg(F.sum("good_lost"), F.sum("toxic_lost")).first() == (0, 0)


def packed_rightly(rows, sizes, capacity):
    """Every piece once, in sequences without holes or overlaps; returns how many sequences."""
    by = defaultdict(list)
    for i, seq, at in rows:
        by[seq].append((at, sizes[i]))
    assert sorted(i for i, _, _ in rows) == sorted(sizes)
    for own in by.values():
        end = 0
        for at, n in sorted(own):
            assert at == end
            end += n
        assert end <= capacity
    return len(by)


def best_fit_decreasing(sizes, capacity):
    room, n = [0] * (capacity + 1), 0
    for x in sorted(sizes, reverse=True):
        gap = next((g for g in range(x, capacity + 1) if room[g]), None)
        n += gap is None
        room[gap or 0] -= gap is not None
        room[(gap or capacity) - x] += 1
    return n


@pytest.mark.parametrize("name,sweep_rows", [("even", 1 << 17), ("even", 60), ("small", 40), ("equal", 30), ("ones", 50), ("full", 20)])
def test_packing_is_as_tight_as_best_fit(spark, name, sweep_rows):
    rng = random.Random(name)
    sizes = {"even": [rng.randint(1, 256) for _ in range(700)], "small": [rng.randint(1, 30) for _ in range(600)], "equal": [85] * 200, "ones": [1] * 700 + [rng.randint(1, 256) for _ in range(60)], "full": [256] * 50 + [128] * 20 + [129, 127]}[name]
    sizes = dict(enumerate(sizes))
    df = spark.createDataFrame(list(sizes.items()), "id long, size long")
    n = packed_rightly([tuple(r) for r in packing.pack(df, 256, sweep_rows, min(sweep_rows, 50)).collect()], sizes, 256)
    assert n <= 1.02 * best_fit_decreasing(sizes.values(), 256) + 1


def test_across_gives_each_rank_once():
    """Ranges' documents go to gaps of ranges above, the largest first."""
    out = packing._across([(0, 5, 10, 0, None), (1, 2, 20, 1, 15), (2, 0, None, 2, 55), (3, 1, 60, 0, None)])
    assert out == [(0, 4, 5, 1, 0, 1), (1, 0, 2, 2, 0, 2), (0, 0, 4, 2, 1, 5)]


def test_pieces_and_places_of_whole_texts(spark, small):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(PATH)
    odd = [None, "", " ", "it's <|endoftext|> x", "naïve 😀 \x1c\x85 東京", "x" * 30_000, "word " * 9_000, "word " * 2047, "word " * 2046 + "word", "word " * 2045 + "word"]
    rows = [(i, t) for i, t in enumerate(odd)] + [(None, "no id"), (1, ""), (6, "again")] + [(100 + i, r["text"]) for i, r in enumerate(spark.read.parquet(f"{small}/documents.parquet").collect())]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"piece": F.lit("clash"), "length": F.lit(0), "id": F.lit("x"), "size": F.lit(1), "kind": F.lit(2), "__piece": F.lit(0)})
    found = packing.best_fit(df, PATH, P.PATTERN, sweep_rows=64, least_rows=32).collect()
    assert found[0].__fields__ == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    want = []
    for d, t in rows:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
        first = len(ids) % 2048 or 2048
        cuts = [0, *range(first, len(ids) + 1, 2048)]
        want += [(d, k, lo, hi - lo, zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids[lo:hi]))) for k, (lo, hi) in enumerate(zip(cuts, cuts[1:]))]
    key = lambda x: tuple((v is not None, v or 0) for v in x)
    assert sorted(map(tuple, (r[:5] for r in found)), key=key) == sorted(want, key=key)
    sizes = {i: r["length"] for i, r in enumerate(found)}
    n = packed_rightly([(i, r["sequence_id"], r["offset"]) for i, r in enumerate(found)], sizes, 2048)
    assert n <= 1.02 * best_fit_decreasing(sizes.values(), 2048) + 1


def test_plain_texts_match_as_the_pattern_says():
    """Every character that counts as plain, among others and at either end."""
    codec = packing.FileCodec(PATH, P.PATTERN)
    chars = [chr(c) for c in range(0x2100) if codec.is_plain(chr(c))]
    assert len(chars) > 700 and not codec.is_plain("東") and not codec.is_plain("\x1c")
    for c in chars:
        for text in (f"a{c}b 1{c}2 .{c}!\n{c}{c} ", f"{c}'s {c}ll 'll{c} \n {c}", f" {c}  {c}\t{c}"):
            assert codec.match_plain(text) == codec.match(text)


def test_ids_of_matches_are_those_of_the_tokenizer():
    from tokenizers import Tokenizer

    tokenizer, codec = Tokenizer.from_file(PATH), packing.FileCodec(PATH, P.PATTERN)
    for text in ("".join(map(chr, range(0x300))), " ".join(chr(c) * 3 for c in range(0x2000)), "ÿ\xff þé \x00\x01 \ufdd0 \U0010ffff 東京 😀😀", "a\xadb \x7f\xa0"):
        for _ in range(2):
            assert np.frombuffer(codec.encode(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_matches_in_use_are_encoded_once():
    """290,000 words in turn, twice: a worker's memory holds them."""
    codec = packing.FileCodec(PATH, P.PATTERN)
    letters = "abcdefghij"
    words = [" x" + "".join(letters[int(d)] for d in str(n)) for n in range(290_000)]
    asked, inner = [], codec.piece

    class Counting:
        def encode_batch_fast(self, rows, **options):
            asked.append(len(rows))
            return inner.encode_batch_fast(rows, **options)

    codec.piece = Counting()
    for _ in range(2):
        for i in range(0, len(words), 5_000):
            codec.encode("".join(words[i : i + 5_000]))
    assert sum(asked) == len(words)


def test_packing_of_nothing(spark):
    assert packing.best_fit(spark.createDataFrame([], "doc_id string, text string"), PATH, P.PATTERN).count() == 0
    common.release(spark)
