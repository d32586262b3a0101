"""Operators 6, 7 and 8, components and the pipeline against brute force and SQL."""

import pathlib
import random

import pytest
from pyspark.sql import functions as F

from tallyfold.llm import chat, components, jaccard, licenses, queries


def shingle_set(text):
    w = (text or "").translate({c: c + 32 for c in range(65, 91)}).encode().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) or (frozenset([tuple(w)]) if w else frozenset())


def brute(rows):
    ids = [i for i, _ in rows]
    sets = {i: shingle_set(t) for i, t in rows}
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, a in enumerate(ids):
        for b in ids[:k]:
            n = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * n >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def corpus(seed, n=120):
    r = random.Random(seed)
    word = lambda: r.choice("abcdefghijklmnop") + r.choice("aeiou") + r.choice("xyz")
    hot = [word() for _ in range(40)]
    texts = []
    for _ in range(n):
        kind = r.random()
        if texts and kind < 0.5:
            w = (r.choice(texts) or "").split()
            for _ in range(r.choice([0, 1, 1, 2, 3])):
                if w:
                    w[r.randrange(len(w))] = word()
            texts.append(" ".join(w[: len(w) - r.choice([0, 0, 5])]))
        elif kind < 0.7:
            texts.append(" ".join(hot + [word() for _ in range(r.randint(0, 30))]))
        else:
            texts.append(" ".join(word() for _ in range(r.randint(1, 80))))
    return [*texts, None, "", " \n", "One two", "ONE  TWO", "one"]


@pytest.mark.parametrize("seed, bounds", [(0, {}), (1, {"column_entries": 50, "rows": 3}), (2, {"column_entries": 300, "rows": 8, "most_frequent": 5, "narrow": 3}), (3, {"rows": 2, "most_frequent": 0, "narrow": 2})])
def test_components_of_all_links(spark, seed, bounds):
    rows = [(i * 3 + 7, t) for i, t in enumerate(corpus(seed))]
    random.Random(seed).shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"n": F.lit("x"), "class": F.lit("y"), "component_id": F.lit(0), "grams": F.lit(1)}).repartition(3)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.join(df, **bounds).collect()}
    assert got == brute(rows)


def test_the_query_equals_brute_force(spark, small):
    rows = sorted(map(tuple, spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in queries.op8_jaccard_join(spark, small).collect()}
    assert got == brute(rows)


def test_join_edge_cases(spark):
    df = spark.createDataFrame([(5, "a b c d e f g"), (5, "a b c d e f g"), (None, "a b c d e f g"), (2, "A B C D E F G"), (None, None), (9, "word " * 60_000)], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["component_id"]) for r in jaccard.join(df).collect()), key=str)
    assert got == sorted([(5, 2), (5, 2), (None, 2), (2, 2), (None, None), (9, 9)], key=str)
    assert jaccard.join(df.limit(0)).count() == 0


def test_surely_wide_columns_are_dealt_by_class(spark, monkeypatch):
    """N-grams of the most frequent list that count as wide without a look at their column."""
    monkeypatch.setattr(jaccard, "SURELY_WIDE", 8)
    r = random.Random(5)
    base = [f"b{i}" for i in range(120)]
    near = [" ".join(x if i not in (k, 3 * k) else f"own{k}" for i, x in enumerate(base)) for k in range(30)]
    rows = list(enumerate([*near, *corpus(5, 60)]))
    r.shuffle(rows)
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in jaccard.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), column_entries=200).collect()}
    assert got == brute(rows)


def test_prefixes_of_linked_sets_share_what_is_needed():
    """The bound of the pair counts, on random pairs of linked sets in a random order of n-grams."""
    import numpy as np

    r = random.Random(0)
    for _ in range(3000):
        both = r.randint(1, 60)
        a, b = r.randint(0, both // 4), r.randint(0, both // 4)
        x, y = [*range(both), *range(100, 100 + a)], [*range(both), *range(200, 200 + b)]
        if 100 * both < 80 * (both + a + b):
            continue
        order = list(range(300))
        r.shuffle(order)
        first = lambda s: set(sorted(s, key=order.__getitem__)[: jaccard.prefix(len(s))])
        need = int(jaccard.needed(np.array(len(x)), np.array(len(y))))
        assert len(first(x) & first(y)) >= need >= 1


def test_links_at_the_bound_count(spark):
    w = [f"w{i}" for i in range(94)]  # 90 shingles; ten less on one side: 80 of 100
    a, b = " ".join(w), " ".join([f"v{i}" for i in range(10)] + w[10:])
    rows = [(1, a), (2, b), (3, " ".join(w[:76])), (4, " ".join(w[:75]))]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows) and got[3][1] == 1


@pytest.mark.parametrize("seed, bounds", [(0, {}), (1, {"column_entries": 50, "rows": 3}), (2, {"column_entries": 300, "rows": 8, "most_frequent": 5, "narrow": 2}), (3, {"grams": 400, "narrow": 40})])
def test_all_links_are_counted(spark, seed, bounds):
    r = random.Random(seed)
    base = [f"b{i}" for i in range(200)]
    near = [" ".join(x if i != k else f"own{k}" for i, x in enumerate(base)) for k in range(40)]  # each links with each
    rows = list(enumerate([*corpus(seed), *near, *near[:7], " ".join(base[:180]), near[0].upper()]))
    r.shuffle(rows)
    sets = {i: shingle_set(t) for i, t in rows}
    want = {i: sum(1 for j in sets if j != i and sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])) for i in sets}
    got = {x["doc_id"]: x for x in jaccard.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), **bounds).collect()}
    assert {i: x["n_links"] for i, x in got.items()} == want and sum(want.values()) // 2 > 40 * 39 // 2
    assert all((got[i]["class"] == got[j]["class"]) == (sets[i] == sets[j]) for i in sets for j in sets if sets[i] and sets[j])


def test_the_query_returns_class_and_links(spark, small):
    got = queries.op8_jaccard_join(spark, small)
    assert got.columns == ["doc_id", "n_shingles", "class", "n_links", "component_id"]
    assert got.filter("class is null and n_links <> 0").count() == 0 and got.filter("n_links > 0").count() > 0


@pytest.mark.parametrize("seed", range(3))
def test_connected_components(spark, seed):
    r = random.Random(seed)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(20)]
    root = {x: x for e in edges for x in e}
    for _ in root:
        for a, b in edges:
            m = min(root[a], root[b])
            root[a] = root[b] = m
    want = {x: m for x, m in root.items() if any(a != b and x in (a, b) for a, b in edges)}
    got = {x["node"]: x["root"] for x in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == want


def test_chats(spark):
    turns = {1: ["hi", "yo"], 2: ["hi", "yo", "more"], 3: ["hi", "yo", "more"], 4: ["hi"], 5: ["other"], 6: ["hi", None], 7: ["hi", ""], 8: ["hi", "yo", "else"]}
    rows = [(c, 10 + 3 * k, "user" if k % 2 == 0 else "bot", t) for c, ts in turns.items() for k, t in enumerate(ts)] + [(None, 0, "user", "hi"), (9, None, None, "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"hashes": F.lit(1), "last": F.lit(2)})
    got = {r["conv_id"]: r for r in chat.format_chats(df.repartition(3)).collect()}
    assert sorted(got) == [2, 5, 6, 7, 8, 9] and got[2]["n_copies"] == 2 and got[2]["n_turns"] == 3
    assert got[2]["rendered"] == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>bot\nyo<|im_end|>\n<|im_start|>user\nmore<|im_end|>\n"
    assert got[6]["rendered"] == got[7]["rendered"] and got[9]["rendered"] == "<|im_start|>\nx<|im_end|>\n"
    assert chat.format_chats(df.limit(0)).count() == 0


def test_very_long_conversations(spark):
    rows = [(c, t, "user", f"turn {t}") for c, n in ((1, 3000), (2, 2999), (3, 3000), (4, 2999)) for t in range(n)] + [(4, 2999, "user", "another")]
    got = {r["conv_id"]: (r["n_turns"], r["n_copies"], r["rendered"].count(chat.END)) for r in chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)).collect()}
    assert got == {1: (3000, 2, 3000), 4: (3000, 1, 3000)}


def test_licences(spark):
    mit = dict(licenses.KNOWN[:1])["MIT"]
    texts = [mit, "Copyright (c) 2020 Someone\n\n" + mit.upper().replace('"', "``"), "/* " + mit.replace("sublicense", "sub-license").replace("\n", "\n * ") + " */\n# (C) me", mit.replace("Software", "Thing"), None, "", "...", "Released under the MIT Licence", "© 2021 x\nAll rights reserved."]
    got = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("digest", F.lit("clash"))).collect()}
    assert [got[i]["license_id"] for i in range(len(texts))] == ["MIT", "MIT", "MIT", None, None, None, None, "MIT", None]
    assert got[4]["digest"] is got[5]["digest"] is got[6]["digest"] is got[8]["digest"] is None and got[3]["digest"]
    own = spark.createDataFrame([(got[3]["digest"], "thing")], "digest string, license_id string")
    assert licenses.scan(spark.createDataFrame([(3, texts[3])], "doc_id long, text string"), licences=own).first()["license_id"] == "thing"
    assert licenses.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_the_licence_query_equals_its_sql_where_licences_are_found(spark, tmp_path):
    import duckdb

    texts = [t for _, t in licenses.KNOWN] + [t.upper().replace("\n", "\n// ") for _, t in licenses.KNOWN] + ["Copyright 2020 me\n" + t for _, t in licenses.KNOWN[:4]] + ["Some prose.\n" + licenses.KNOWN[0][1], None, ""]
    at = pathlib.Path("/usr/share/common-licenses")
    texts += [p.read_text() for p in sorted(at.glob("*")) if at.exists() and not p.is_symlink()]
    rows = [(i, t) for i, t in enumerate(texts)]
    spark.createDataFrame([*rows, rows[0]], "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = sorted(map(str, con.execute(queries.SQL["op7_license_scan"]).fetchall()))
    got = queries.op7_license_scan(spark, str(tmp_path)).select("doc_id", "digest", "license_id").collect()
    assert sorted(str(tuple(r)) for r in got) == want
    found = {r["doc_id"]: r["license_id"] for r in got}
    n = len(licenses.KNOWN)
    assert [found[i] for i in range(n)] == [found[n + i] for i in range(n)] == [i for i, _ in licenses.KNOWN] and sum(x is not None for x in found.values()) >= 2 * n + 4
    assert [found[i] for i in range(2 * n + 4, 2 * n + 7)] == [None] * 3
    twice = licenses.known(spark).union(licenses.known(spark).withColumn("license_id", F.lit("zzz")))
    assert licenses.scan(spark.createDataFrame(rows[:1], "doc_id long, text string"), licences=twice).collect()[0]["license_id"] == "MIT"


def test_whole_licence_texts(spark):
    at = pathlib.Path("/usr/share/common-licenses")
    want = {"Apache-2.0": "Apache-2.0", "Artistic": "Artistic-1.0-Perl", "BSD": "BSD-3-Clause", "CC0-1.0": "CC0-1.0", "GFDL-1.3": "GFDL-1.3", "GPL-1": "GPL-1.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-1.1": "MPL-1.1", "MPL-2.0": "MPL-2.0"}
    found = {f: (at / f).read_text() for f in want if (at / f).exists()}
    if not found:
        pytest.skip("no licence texts on this machine")
    end = "END OF TERMS AND CONDITIONS"
    rows = [(f, t) for f, t in found.items()] + [(f, t.upper().replace("\n", "\n# ")) for f, t in found.items() if f == "MPL-2.0"] + [(f, t.partition(end)[0] + end) for f, t in found.items() if end in t]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    assert sorted((r["doc_id"], r["license_id"]) for r in got) == sorted((f, want[f]) for f, _ in rows)
    known = licenses.known(spark)
    assert known.count() == known.select("digest").distinct().count() > len(licenses.KNOWN)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_queries_equal_their_sql(spark, small, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "labels"):
        con.execute(f"create view {t} as select * from '{small}/{t}.parquet'")
    got = con.execute(queries.SQL[name])
    names = [d[0] for d in got.description]
    want = sorted(map(str, got.fetchall()))
    df = queries.QUERIES[name](spark, small)
    assert sorted(df.columns) == sorted(names) and sorted(str(tuple(r[c] for c in names)) for r in df.collect()) == want


@pytest.mark.parametrize("name", ["op6_chat_format", "op7_license_scan", "op9_line_dedup"])
def test_native_plans_run_no_python(spark, small, name):
    df = queries.QUERIES[name](spark, small)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "CartesianProduct"))


def test_join_batches_are_bounded(spark, monkeypatch):
    """Whatever a task of the join sends to the JVM, sets, counts, packed columns and overlaps, it sends in batches of the size named."""
    import numpy as np

    works, real = [], jaccard._in_arrow
    monkeypatch.setattr(jaccard, "_in_arrow", lambda df, work, schema: works.append((df, work)) or real(df, work, schema))
    rng = np.random.default_rng(3)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz"))
    texts = [" ".join(rng.choice(letters, 4000).tolist()) for _ in range(60)]
    rows = [(i, texts[i % 60] + f" {i} {i}") for i in range(240)]
    stored = jaccard.sets(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), "doc_id", "text")
    packed = jaccard.columns(stored, jaccard.frequent(stored), 1)
    jaccard.shared_columns(packed, 1, narrow=2)
    assert len(works) == 4
    monkeypatch.undo()
    for (df, work), most in zip(works, (jaccard.BATCH_BYTES, jaccard.BATCH_BYTES, jaccard.PACK_BYTES, jaccard.BATCH_BYTES)):
        given = df.toArrow()
        sent = list(work(given.to_batches(max_chunksize=512)))
        assert len(sent) > 1 and max(b.nbytes for b in sent) <= 1.1 * most, (given.num_rows, [b.nbytes for b in sent])
    got = {r["component_id"] for r in jaccard.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == set(range(60))


def test_pipeline_stages(spark, small):
    """Each stage against its own brute force on its own input."""
    import corpus_pipeline as cp
    from tests.llm.test_text_operators import hit_words

    assert [n for n, _ in cp.STAGES] == ["language", "line_dedup", "near_duplicates", "decontaminate", "encode"]
    docs = spark.read.parquet(f"{small}/documents.parquet").union(spark.createDataFrame([(10**6, "12 34 !!", "en", "src0", 8)], "doc_id long, text string, lang string, source string, n_chars long"))
    keep = lambda df: spark.createDataFrame(df.collect(), df.schema)
    now = keep(cp.language(spark, docs, small))
    assert now.columns == docs.columns and now.count() == docs.count() - 1 and now.filter("doc_id = 1000000").count() == 0
    after = keep(cp.line_dedup(spark, now, small))
    assert after.columns == docs.columns and after.count() == now.count() and after.filter("n_chars <> length(text)").count() == 0
    rows = sorted((r["doc_id"], r["text"]) for r in after.collect())
    single = keep(cp.near_duplicates(spark, after.union(after.limit(3)), small))
    assert sorted(r["doc_id"] for r in single.collect()) == sorted(i for i, (_, c) in brute(rows).items() if i == c) and single.columns == docs.columns
    items = [tuple(r) for r in spark.read.parquet(f"{small}/benchmark.parquet").select("item_id", "text").collect()]
    clean = keep(cp.decontaminate(spark, single, small))
    assert sorted(r["doc_id"] for r in clean.collect()) == sorted(r["doc_id"] for r in single.collect() if not hit_words(r["text"], items)[1])
    coded = cp.encode(spark, clean, small)
    import base64

    import public_tokenizers
    import tiktoken

    from tallyfold.llm import common, langid
    from tests.llm.test_text_operators import brute_language

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    tik = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = {r["doc_id"]: r["text"] for r in clean.collect()}
    assert {r["doc_id"]: list(r["token_ids"]) for r in coded.collect()} == {i: tik.encode_ordinary(t) for i, t in texts.items()} and coded.filter("n_tokens <> size(token_ids)").count() == 0
    model = langid.fit(docs.filter(~common.held_out("doc_id")), public_tokenizers.path("piece_bpe_32k.model"))
    stays = {r["doc_id"] for r in now.collect()}
    for r in docs.filter("length(text) < 600").collect():
        lang, score = brute_language(model, r["text"])
        assert (r["doc_id"] in stays) == (lang != "und" and float(getattr(score, "expected", score)) >= cp.LEAST_LANGUAGE_SCORE)
    assert cp.run(spark, small).count() > 0


def test_pipeline_of_empty_tables(spark, small, tmp_path):
    import corpus_pipeline as cp

    docs, bench = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/benchmark.parquet")
    docs.limit(0).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    bench.limit(0).write.parquet(str(tmp_path / "none" / "benchmark.parquet"))
    assert cp.run(spark, str(tmp_path / "none")).count() == 0
    some = docs.limit(12).withColumn("doc_id", F.when(F.col("doc_id") % 2 == 0, F.col("doc_id")))
    some.write.parquet(str(tmp_path / "some" / "documents.parquet"))
    bench.limit(0).write.parquet(str(tmp_path / "some" / "benchmark.parquet"))
    got = cp.run(spark, str(tmp_path / "some"))
    assert 0 < got.count() <= 12 and got.filter("decoded_sha256 is null or n_tokens is null").count() == 0


def test_pipeline_judges_rows_of_null_and_repeated_ids(spark, small):
    import corpus_pipeline as cp

    leak = spark.read.parquet(f"{small}/benchmark.parquet").filter("length(text) > 200").first()["text"]
    rows = [(None, "a b c d e f g"), (None, "A b c d e f g"), (1, "one text of its own here"), (1, "another clean text with this id"), (3, "x y z u v w"), (2, "x y z u v w"), (None, leak), (7, leak), (7, "a clean row that shares its id")]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted((r["doc_id"] or 0, r["text"].lower()) for r in cp.near_duplicates(spark, df, small).collect())
    assert got == sorted([(0, "a b c d e f g"), (1, rows[2][1]), (1, rows[3][1]), (2, "x y z u v w"), (7, leak.lower()), (7, rows[8][1])])
    got = sorted((r["doc_id"] or 0, r["text"]) for r in cp.decontaminate(spark, df, small).collect())
    assert got == sorted((i or 0, t) for i, t in rows if t != leak)
