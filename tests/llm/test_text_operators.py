"""Operators 1 to 5, 9 and 10 against brute force, round trips and held-out rows, and their edge cases."""

import base64
import collections
import hashlib
import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from tallyfold.llm import common, decontamination, langid, lines, quality, substrings, tokenization, toxicity

P = pytest.importorskip("public_tokenizers")
RANKS, PIECES = P.path("byte_bpe_50k.tiktoken"), P.path("piece_bpe_32k.model")
LONG = "word " * 40_000 + "é" * 70_000
ODD = [None, "", " ", "\n\n", "a", "it's 12'll <|endoftext|>   x", "naïve 😀👩‍👩‍👧 \x1c\x1d\x85 東京", "  leading\n\n  trailing  ", "x" * 70_000, LONG]


def docs(spark, texts, clash=True):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    return df.withColumns({"n_tokens": F.lit("clash"), "score": F.lit(1), "hits": F.lit(None).cast("string"), "grams": F.lit(0), "starts": F.lit(0), "labels": F.lit(0), "__row": F.lit(1)}) if clash else df


@pytest.fixture(scope="module")
def table(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")


@pytest.fixture(scope="module")
def tik():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_ids_equal_tiktokens_and_decode_back(spark, table, tik):
    df = docs(spark, ODD).select("doc_id", "text").union(table.select(F.col("doc_id") + 1000, "text"))
    text = dict(map(tuple, df.collect()))
    coded = tokenization.encode(df, RANKS, P.PATTERN, offsets=True)
    for r in coded.collect():
        t = text[r["doc_id"]] or ""
        assert list(r["token_ids"]) == tik.encode_ordinary(t)
    for r in tokenization.decode(coded, RANKS, P.PATTERN).collect():
        assert bytes(r["decoded"]) == (text[r["doc_id"]] or "").encode() and r["decoded_text"] == (text[r["doc_id"]] or "")


def test_offsets_cover_the_text_and_split_characters(spark, tik):
    t = "a 😀é東"
    r = tokenization.encode(docs(spark, [t]), RANKS, P.PATTERN, offsets=True).first()
    for i, s, e in zip(r["token_ids"], r["char_start"], r["char_end"]):
        piece = tik.decode_single_token_bytes(i)
        assert piece in t[s:e].encode() and piece not in t[s + 1 : e].encode() and piece not in t[s : e - 1].encode()
    assert r["char_start"][0] == 0 and r["char_end"][-1] == len(t)
    half = spark.createDataFrame([(1, list(r["token_ids"])[:2])], "doc_id long, token_ids array<int>")
    assert "�" in tokenization.decode(half, RANKS, P.PATTERN).first()["decoded_text"]
    assert bytes(tokenization.decode(spark.createDataFrame([(1, None)], "doc_id long, token_ids array<int>"), RANKS, P.PATTERN).first()["decoded"]) == b""


def test_a_column_that_would_clash_with_the_id_is_refused(spark):
    with pytest.raises(ValueError):
        tokenization.encode(spark.createDataFrame([(1, "a")], "token_ids long, text string"), RANKS, P.PATTERN, id_col="token_ids")


def test_forward_sums_all_segmentations():
    pieces, _, _ = langid.vocabulary(PIECES)
    import numpy as np

    rng = np.random.default_rng(0)
    model = langid.Model(PIECES, ["a", "b"], rng.dirichlet(np.ones(len(pieces) + 1), 2).T)

    def brute(word, lang):
        if not word:
            return 1.0
        total = 0.0
        for k in range(1, len(word) + 1):
            p = pieces.get(word[:k], -1 if k == 1 else None)
            if p is not None:
                total += model.prob[p, lang] * brute(word[k:], lang)
        return total

    for words in (["the", "x", "straße", "été"], ["中文", "hello"]):
        got = model.words(words)
        for w, row in zip(words, got):
            assert np.exp(row) == pytest.approx([brute("▁" + w, k) for k in (0, 1)], rel=1e-9)
    assert np.isfinite(model.words(["y" * 500])).all()


def test_pieces_of_many_words_at_once():
    pieces, _, _ = langid.vocabulary(PIECES)
    words = ["▁the", "▁x", "▁straße", "▁" + "été" * 30, "▁中文", "▁𝒜b", "▁", "▁ﬁnd", "▁internationalization"]
    want = sorted((w, i, j, pieces.get(x[i:j], -1)) for w, x in enumerate(words) for i in range(len(x)) for j in range(i + 1, len(x) + 1) if x[i:j] in pieces or j == i + 1)
    got = list(zip(*(c.tolist() for c in langid.spans(words, PIECES))))
    assert sorted(got) == want and got == sorted(got, key=lambda r: (r[2], r[0]))


def test_a_full_memory_of_words_hands_on_what_is_in_use(monkeypatch):
    import numpy as np

    pieces, _, _ = langid.vocabulary(PIECES)
    prob = np.random.default_rng(0).dirichlet(np.ones(len(pieces) + 1), 2).T
    many = ["the of and to", "the of in a", "the of and on", "", "the of by is it", "a"]
    want = [langid.Model(PIECES, ["a", "b"], prob).texts([x])[0] for x in many]
    monkeypatch.setattr(langid, "CACHE_WORDS", 4)
    asked, words = [], langid.Model.words
    monkeypatch.setattr(langid.Model, "words", lambda self, new: asked.extend(new) or words(self, new))
    model = langid.Model(PIECES, ["a", "b"], prob)
    assert all(np.allclose(model.texts([x])[0], y, rtol=1e-12) for x, y in zip(many, want))
    assert asked.count("the") == asked.count("of") == 1 and len(model.known) + len(model.before) <= 2 * 5


def test_languages_of_held_out_rows(spark, table):
    model = langid.fit(table.filter(~common.held_out("doc_id")), PIECES)
    got = langid.predict(table, model).join(table.select("doc_id", "lang"), "doc_id").filter(common.held_out("doc_id")).collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) >= 0.97 * len(got)


def brute_language(model, text):
    """Prediction and score by the plain recursion over all segmentations of each word."""
    from functools import lru_cache

    import numpy as np

    pieces, _, _ = langid.vocabulary(PIECES)

    @lru_cache(None)
    def total(word):
        if not word:
            return np.ones(len(model.langs))
        out = np.zeros(len(model.langs))
        for k in range(1, min(len(word), langid.LONGEST + 1) + 1):
            p = pieces.get(word[:k], -1 if k == 1 else None)
            if p is not None:
                out = out + model.prob[p] * total(word[k:])
        return out

    words = re.findall(r"[^\W\d_]+", (text or "").lower())
    if not any(c.isalpha() for w in words for c in w):
        return "und", 0.0
    log = sum(np.log(total("▁" + w)) for w in words)
    odds = np.exp(log - log.max())
    return model.langs[int(log.argmax())], pytest.approx(1 / odds.sum())


def test_predictions_equal_the_plain_recursion(spark, table, small):
    from tallyfold.llm import queries

    model = langid.fit(table.filter(~common.held_out("doc_id")), PIECES)
    rows = queries.op2_language(spark, small).join(table.select("doc_id", "text"), "doc_id").filter("length(text) < 3000").collect()
    assert len(rows) > 50
    for r in rows[:80]:
        assert (r["lang_pred"], r["score"]) == brute_language(model, r["text"])


def test_language_edge_cases(spark, table):
    model = langid.fit(table, PIECES)
    got = {r["doc_id"]: r for r in langid.predict(docs(spark, [*ODD, "12 34 ²", "!!"]), model).collect()}
    assert len(got) == len(ODD) + 2 and all(0 <= r["score"] <= 1 for r in got.values())
    assert [got[i]["lang_pred"] for i in (0, 1, 2, 3, 10, 11)] == ["und"] * 6 and got[4]["lang_pred"] != "und"
    none = langid.fit(table.limit(0), PIECES)
    assert {r["lang_pred"] for r in langid.predict(docs(spark, ["a", None]), none).collect()} == {"und"}
    assert langid.predict(docs(spark, []), model).count() == 0


def toxic_corpus(spark, n=600):
    base = "the cat sat on the mat and looked at rain while people walked home".split()
    rows = []
    for i in range(n):
        r = random.Random(i)
        w = [r.choice(base) + r.choice("aeiou") for _ in range(30)]
        if i % 5 == 0:
            w[i % 25 : i % 25] = ["zorkel" + "abcdefgh"[i % 8], "vile"]
        rows.append((i, " ".join(w), int(i % 5 == 0)))
    return spark.createDataFrame(rows, "doc_id long, text string, toxic int")


def brute_toxicity(model, text):
    """Score and spans by the plain pass over the features of every token."""
    found = list(re.finditer(r"[^\W_]+", text or ""))
    if not found:
        return pytest.approx(model.score((0.0, 0.0, 0.0))), []
    import math

    import numpy as np

    p = model.chain.marginals(model.features(np.array([model.kinds[m[0]] for m in found])))[:, 1]
    spans, last = [], -2
    for i in np.flatnonzero(p >= 0.5):
        if i == last + 1:
            spans[-1] = (spans[-1][0], found[i].end(), max(spans[-1][2], p[i]))
        else:
            spans.append((found[i].start(), found[i].end(), p[i]))
        last = i
    return pytest.approx(model.score((p.max(), math.log1p(p[p >= 0.1].sum()), math.log1p(len(p))))), [(s, e, pytest.approx(q)) for s, e, q in spans]


def test_scores_and_offsets_equal_the_plain_pass_over_every_token(spark, small):
    big = small.replace("0.001", "0.01")
    table, labels = spark.read.parquet(f"{big}/documents.parquet"), spark.read.parquet(f"{big}/labels.parquet")
    model = toxicity.fit(table, labels)
    rows = toxicity.score(table.filter("doc_id % 4 = 1 and length(text) < 20000"), model).join(table.select("doc_id", "text"), "doc_id").collect()
    assert len(rows) > 100
    for r in rows:
        assert (r["score"], [tuple(s) for s in r["spans"]]) == brute_toxicity(model, r["text"])
    held = toxicity.score(table, model).join(labels, "doc_id").filter(common.held_out("doc_id")).collect()
    toxic, clean = [r["score"] for r in held if r["toxic"]], [r["score"] for r in held if not r["toxic"]]
    assert toxic and sum(x >= 0.5 for x in toxic) >= 0.6 * len(toxic) and sum(x >= 0.5 for x in clean) <= 0.02 * len(clean)  # 45 toxic rows to learn from


def test_toxic_spans_and_scores(spark):
    df = toxic_corpus(spark)
    model = toxicity.fit(df, df.select("doc_id", "toxic"))
    got = toxicity.score(df, model).join(df, "doc_id").filter(common.held_out("doc_id")).collect()
    assert got and all((r["score"] >= 0.5) == bool(r["toxic"]) and 0 <= r["score"] <= 1 for r in got)
    for r in got:
        assert [r["text"][s["start"] : s["end"]].split()[0][:6] for s in r["spans"]] == (["zorkel"] if r["toxic"] else [])
    assert [(r["score"], [tuple(s) for s in r["spans"]]) for r in got] == [brute_toxicity(model, r["text"]) for r in got]
    unseen = toxicity.score(docs(spark, ["a zorkelqqq person", "a person", *ODD]), model).orderBy("doc_id").collect()
    assert unseen[0]["score"] > 0.5 > unseen[1]["score"] and unseen[2]["score"] == unseen[3]["score"] < 0.5 and len(unseen) == len(ODD) + 2


def test_toxicity_of_repeated_rows_and_a_tie(spark, monkeypatch):
    df = toxic_corpus(spark, 200)
    model = toxicity.fit(df, df.select("doc_id", "toxic").union(df.select("doc_id", "toxic")))
    same = toxicity.score(df.union(df).withColumn("doc_id", F.lit(None).cast("long")), model).groupBy("score").count().collect()
    assert sum(r["count"] for r in same) == 400 and all(r["count"] % 2 == 0 for r in same)
    assert abs(toxicity.Model().score((0.0, 0.0, 0.0)) - 0.25) < 1e-12  # an empty model marks nothing
    from tallyfold.llm import queries

    monkeypatch.setattr(queries.toxicity, "fit", lambda *_: toxicity.Model())
    monkeypatch.setattr(queries, "_table", lambda *_: df)
    assert {(r["score"], r["predicted"]) for r in queries.op3_toxicity(spark, "").collect()} == {(0.25, 0)}


def test_toxicity_without_labels_finds_nothing(spark):
    df = toxic_corpus(spark, 20)
    none = spark.createDataFrame([(None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.fit(df, none)
    assert {(round(r["score"], 12), len(r["spans"])) for r in toxicity.score(df, model).collect()} == {(0.25, 0)}
    assert toxicity.score(docs(spark, []), model).count() == 0


def hit_words(text, items):
    low = lambda s: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), s or ""))
    w, hit, found = low(text), set(), []
    for i, item in items:
        x = low(item)
        n = min(10, len(x))
        wins = {tuple(x[k : k + n]) for k in range(len(x) - n + 1)} if x else set()
        at = [k for k in range(len(w) - n + 1) if n and tuple(w[k : k + n]) in wins]
        if at:
            found.append(i)
        hit |= {p for k in at for p in range(k, k + n)}
    return len(w), len(hit), sorted(map(str, found))


@pytest.mark.parametrize("sizes", [{}, {"block_chars": 40, "shard_chars": 60}])
def test_phrases_equal_brute_force(spark, sizes):
    items = [(1, "The quick brown fox jumps over the lazy dog today and then"), (2, "short one"), (3, None), (4, "..."), (5, "a a a a a a a a a a a"), (6, "The quick brown fox jumps over the lazy dog today and then"), (7, "ÉTÉ é")]
    texts = [*ODD, "x THE quick, brown fox jumps over the lazy dog TODAY! and then y the quick brown fox jumps over the lazy dog today", "short, one short one", "a " * 25, "Été É ÉTÉ é", "the quick brown fox jumps over the lazy dog", "short", "short one short"]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.phrases(docs(spark, texts), bench, **sizes).collect()
    assert len(got) == len(texts)
    for r in got:
        want = hit_words(texts[r["doc_id"]], items)
        assert (r["n_words"], sum(h["end"] - h["start"] for h in r["hits"]), sorted(map(str, r["items"]))) == want


def test_shards_of_many_partitions_keep_apart(spark):
    """Documents, rows and shards of many partitions stay distinct."""
    df = spark.range(0, 300, 1, 50).select(F.col("id").alias("doc_id"), F.concat(F.lit("one two three four x"), F.col("id").cast("string")).alias("text"))
    got = decontamination.phrases(df, spark.createDataFrame([(1, "two three four")], "item_id long, text string")).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(300)) and {(r["n_words"], len(r["hits"])) for r in got} == {(5, 1)}
    kept = common.keep(df.select(F.monotonically_increasing_id().alias("row")), "rows")
    assert kept.select("row").distinct().count() == 300
    assert {r["n_removed"] for r in substrings.dedup(df).collect()} == {0}


def test_phrases_of_empty_tables_and_repeated_rows(spark):
    bench = spark.createDataFrame([(1, "one two")], "item_id long, text string")
    assert decontamination.phrases(docs(spark, []), bench).count() == 0
    assert {len(r["hits"]) for r in decontamination.phrases(docs(spark, ["one two"]), bench.limit(0)).collect()} == {0}
    twice = docs(spark, ["one two"]).union(docs(spark, ["one two"])).union(docs(spark, ["one two"]).withColumn("doc_id", F.lit(None).cast("long")))
    assert [len(r["hits"]) for r in decontamination.phrases(twice, bench).collect()] == [1, 1, 1]


def test_proximity(spark):
    df = docs(spark, ["red x x blue y red", "blue red", "red " * 5, None, "red a a a a a a blue"])
    got = sorted(tuple(r) for r in decontamination.proximity(decontamination.index(df), ["red blue", ""], 4).collect())
    assert got == [(0, 0, 0, 4), (0, 0, 3, 6), (1, 0, 0, 2)]


PASSAGE = "Alpha beta gamma delta one. Second sentence follows here now. Third one is also quite long. A fourth closes the passage well."


def test_substrings_leave_the_first_and_clean_text_alone(spark):
    texts = [f"Unique start {i} of this document number {i}. {PASSAGE if i in (1, 3, 4) else ''} Own end {i * 7} closes it." for i in range(6)]
    texts += [None, "", "One. Two. Three. One. Two. Three.", PASSAGE + " Mid part is here. " + PASSAGE, " ".join(f"w{k}" for k in range(200)), "a " + " ".join(f"w{k}" for k in range(200)), LONG]
    got = {r["doc_id"]: r for r in substrings.dedup(docs(spark, texts)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        if i in (3, 4):
            assert "gamma" not in got[i]["text"] and f"Unique start {i}" in got[i]["text"] and f"Own end {i * 7} closes it." in got[i]["text"]
        elif i == 9:
            assert "gamma" not in got[i]["text"] and "Mid part is here." in got[i]["text"]
        elif i == 11:
            assert got[i]["n_removed"] > 0 and len(got[i]["text"]) < len(t) / 2  # cuts follow the content, not the position
        elif i < 12:
            assert (got[i]["text"], got[i]["n_removed"]) == (t, 0)


def brute_substrings(rows, run, least):
    seen, out = set(), {}
    for i, t in rows:
        s = substrings.sentences(t or "")
        gone = set()
        for k in range(len(s) - run + 1):
            if sum(x[3] for x in s[k : k + run]) >= least:
                key = tuple(x[2] for x in s[k : k + run])
                gone |= set(range(k, k + run)) if key in seen else set()
                seen.add(key)
        out[i] = len(gone)
    return out


def test_substrings_equal_brute_force(spark, table):
    rows = sorted(map(tuple, table.select("doc_id", "text").collect()))
    got = {r["doc_id"]: r["n_removed"] for r in substrings.dedup(table).collect()}
    assert got == brute_substrings(rows, substrings.RUN, substrings.MIN_WORDS)


def repeats(k):
    """A passage of 51 words, of a shape that depends on k."""
    r = random.Random(k)
    w = [f"p{k}x{r.randrange(10**6)}" for _ in range(51)]
    if k % 5 == 0:
        return "!! ".join(w)  # sentences of one word
    if k % 5 == 1:
        return "\n".join(" ".join(w[i : i + 3]) for i in range(0, 51, 3))  # short lines
    if k % 5 == 2:
        return " ".join(w)  # no mark at all
    if k % 5 == 3:
        return " ".join(sorted(w, key=lambda x: xxhash.xxh3_64_intdigest(x)))  # hashes in order: no word comes first but the last
    return " ".join(x + "." * (r.random() < 0.06) for x in w)


def test_substrings_see_every_repeat_of_over_50_words(spark):
    own = lambda r, n: " ".join(f"o{r.randrange(10**9)}" + r.choice(["", "", "", ".", "\n"]) for _ in range(n))
    texts = []
    for copy in range(2):
        r = random.Random(copy)
        for k in range(300):
            texts.append(f"{own(r, r.randint(1, 40))} {repeats(k)} {own(r, r.randint(1, 40))}")
        texts.append(f"{own(r, 9)} {'again ' * 51}{own(r, 9)}")
    got = {r["doc_id"]: (r["text"], r["n_removed"]) for r in substrings.dedup(docs(spark, texts)).collect()}
    assert [i for i in range(300) if got[i] != (texts[i], 0)] == [] and [i for i in range(301, 602) if got[i][1] == 0] == []
    assert all(w in got[i][0] for i in range(301, 601) for w in texts[i].split() if w.startswith("o"))


def test_substrings_of_repeated_ids_keep_one(spark):
    df = spark.createDataFrame([(1, PASSAGE), (1, PASSAGE), (None, PASSAGE)], "doc_id long, text string")
    got = substrings.dedup(df).collect()
    assert sorted((r["doc_id"] or 0, r["n_removed"]) for r in got) == [(0, 0), (1, 4), (1, 4)]
    assert substrings.dedup(df.limit(0)).count() == 0


def test_substrings_go_by_the_order_of_text_ids(spark):
    df = spark.createDataFrame([("b", PASSAGE), ("a", PASSAGE), ("a10", PASSAGE)], "doc_id string, text string")
    assert {r["doc_id"]: r["n_removed"] for r in substrings.dedup(df.repartition(3)).collect()} == {"a": 0, "a10": 4, "b": 4}


def test_a_very_long_sentence_keeps_what_is_its_own(spark):
    """Two texts of 20,000 words without a mark, which share the middle third."""
    own = lambda k, n: " ".join(f"w{k}x{i}" for i in range(n))
    shared = own("s", 7000)
    texts = [f"{own(i, 6500)} {shared} {own(i + 9, 6500)}" for i in range(2)]
    got = {r["doc_id"]: r["text"] for r in substrings.dedup(docs(spark, texts)).collect()}
    assert got[0] == texts[0] and all(w in got[1] for w in (own(1, 6480), own(10, 6500)[20:]))
    assert 0 <= sum(f"wsx{i} " in got[1] for i in range(7000)) <= 40


def test_lines_of_very_long_and_repeated_texts(spark):
    long = "\n".join(f"line {i}" for i in range(50_000))
    rows = [(i, "h", f"menu\nown {i}") for i in range(20)] + [(100, "h", f"menu\n{long}\nmenu"), (100, "h", f"menu\n{long}\nmenu")]
    got = [r for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, site string, text string"), "site", ratio=0.5, out_cols=["doc_id"]).collect() if r["doc_id"] == 100]
    assert [(r["text"] == long, r["n_lines"], r["n_dropped"]) for r in got] == [(True, 50_002, 2)] * 2


def test_lines_by_host_frequency(spark):
    rows = [(i, "h", f"own {i}\nnav\n\nnav") for i in range(10)] + [(20 + i, None, f"nav\nz{i}") for i in range(5)] + [(30, "one", "nav"), (31, "h", None), (32, "h", ""), (33, "h", "nav")]
    df = spark.createDataFrame(rows, "doc_id long, site string, text string").withColumns({"n_lines": F.lit("x"), "host": F.lit("y"), "__drop": F.lit(1)})
    got = {r["doc_id"]: r for r in lines.dedup_lines(df, "site", ratio=0.5, min_pages=3, out_cols=["doc_id"]).collect()}
    assert [tuple(got[i])[1:] for i in (0, 20, 30, 31, 32, 33)] == [("own 0\n", 4, 2), ("z0", 2, 1), ("nav", 1, 0), (None, 0, 0), ("", 1, 0), ("", 1, 1)]
    assert lines.dedup_lines(df.limit(0), "site", out_cols=["doc_id"]).count() == 0
    assert lines.dedup_lines(df.union(df), "site", ratio=0.5, min_pages=3, out_cols=["doc_id"]).count() == 2 * len(rows)


def counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    split = (text or "").split("\n")
    dup = sum(bool(re.search(r"[^\x20\x09-\x0D]", x)) and x in split[:i] for i, x in enumerate(split)) if len(split) < 3000 else 0
    wins = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often = {w for w, n in collections.Counter(wins).items() if n > 1}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len({p for i, w in enumerate(wins) if w in often for p in range(i, i + 8)})


def test_quality_counts_equal_brute_force(spark, table, small):
    df = table.select("doc_id", "text").union(docs(spark, ODD).select(F.col("doc_id") + 10_000, "text"))
    chain = quality.fit(table, spark.read.parquet(f"{small}/labels.parquet"))
    text = dict(map(tuple, df.collect()))
    for r in quality.judge(df, chain).collect():
        want = counts(text[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0]) and not (r["kept"] and r["base_failed"])
        assert len(r["labels"]) == (text[r["doc_id"]] or "").count("\n") + 1


@pytest.fixture(scope="module")
def judged(spark, small):
    big = small.replace("0.001", "0.01")
    table, labels = spark.read.parquet(f"{big}/documents.parquet"), spark.read.parquet(f"{big}/labels.parquet")
    chain = quality.fit(table, labels)
    return chain, quality.judge(table, chain).join(labels, "doc_id").withColumn("held", common.held_out("doc_id")).collect()


def test_quality_keeps_good_labels_and_drops_bad(judged):
    held = [r for r in judged[1] if r["held"]]
    good, bad = [r for r in held if r["quality"] and not r["base_failed"]], [r for r in held if not r["quality"]]
    assert len(good) > 40 and sum(r["kept"] for r in good) >= 0.98 * len(good) and sum(r["kept"] for r in bad) <= 0.2 * len(bad)


def test_quality_labels_lines_within_a_document(spark, judged):
    prose = "The house stands near the river and people walk there. In the evening the light falls on the old wall."
    junk = ["| ".join(f"link{i}x{k} " for i in range(12)) for k in range(3)]
    marks = " ".join(f"word{i}$$$ of### that***" for i in range(6))
    text = "\n".join([prose, *junk, prose + " Nothing else happened.", "A second line of plain text follows it, as in any story.", marks, "Later they went home, and the rain began to fall again."])
    row = quality.judge(docs(spark, [text]), judged[0]).first()
    assert list(row["labels"]) == [0, 1, 1, 1, 0, 0, 1, 0]
    words = [len(x.split()) for x in text.split("\n")]
    assert row["content_share"] == pytest.approx(sum(n for n, s in zip(words, row["labels"]) if s == 0) / sum(words)) and 0 < row["content_share"] < 1
    shares = [r["content_share"] for r in judged[1] if not r["quality"]]
    assert sum(0 < s < 1 for s in shares) > 5 and sum(s == 0 for s in shares) > 5


def test_quality_verdict_is_that_of_the_best_path(spark, judged, table):
    """The query's kept and content_share against all paths of short texts, enumerated."""
    import itertools

    import numpy as np

    chain = judged[0]
    few = table.filter("length(text) - length(replace(text, '\n', '')) between 1 and 7").select("doc_id", "text")
    rows = {r["doc_id"]: r for r in quality.judge(few.union(few.limit(2)), chain).collect()}
    for i, text in map(tuple, few.collect()):
        counted, x, sizes = quality.read(text, quality.Hashes())
        u = x @ chain.weights
        value = lambda p: sum(u[t, s] for t, s in enumerate(p)) + sum(chain.moves[a, b] for a, b in zip(p, p[1:]))
        best = max(itertools.product((0, 1), repeat=len(u)), key=lambda p: (round(value(p), 9), [-s for s in p]))
        share = float(sizes[np.array(best) == 0].sum() / counted[0]) if counted[0] else 0.0
        assert rows[i]["content_share"] == pytest.approx(share) and rows[i]["kept"] == (not rows[i]["base_failed"] and share >= quality.CONTENT_SHARE)


def test_viterbi_finds_the_best_path():
    import itertools

    import numpy as np

    from tallyfold.llm import crf

    rng = np.random.default_rng(1)
    for k in (2, 3):
        for _ in range(20):
            chain, x = crf.Chain(rng.normal(size=(4, k)), rng.normal(size=(k, k))), rng.normal(size=(5, 4))
            u = x @ chain.weights
            paths = list(itertools.product(range(k), repeat=5))
            value = np.array([sum(u[t, s] for t, s in enumerate(p)) + sum(chain.moves[a, b] for a, b in zip(p, p[1:])) for p in paths])
            assert tuple(chain.viterbi(x)) == paths[int(value.argmax())]
            weight = np.exp(value) / np.exp(value).sum()
            want = np.array([[sum(w for p, w in zip(paths, weight) if p[t] == s) for s in range(k)] for t in range(5)])
            assert chain.marginals(x) == pytest.approx(want)


def test_queries_return_their_columns(spark, small):
    from tallyfold.llm import queries

    want = {
        "op1_byte_bpe": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"], "op2_language": ["doc_id", "held_out", "lang_pred", "score"], "op3_toxicity": ["doc_id", "held_out", "score", "predicted"],
        "op5_substring_dedup": ["doc_id", "text", "n_removed"], "op10_quality": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
    }
    for name, cols in want.items():
        df = queries.QUERIES[name](spark, small)
        assert df.columns[: len(cols)] == cols and df.count() == 200
    r = queries.op1_byte_bpe(spark, small).join(spark.read.parquet(f"{small}/documents.parquet"), "doc_id").first()
    assert r["decoded_sha256"] == hashlib.sha256(r["text"].encode()).hexdigest()


def test_quality_edge_cases(spark, table):
    none = quality.fit(table, spark.createDataFrame([(None, 1), (1, None)], "doc_id long, quality int"))
    got = quality.judge(docs(spark, ["w%d " % 3 * 30 + " ".join(f"w{i}" for i in range(80)), None]), none).collect()
    assert [(r["kept"], r["base_failed"]) for r in got] == [(True, False), (False, True)]
    assert quality.judge(docs(spark, []), none).count() == 0


def test_encoding_an_empty_table_and_repeated_rows(spark):
    assert tokenization.encode(docs(spark, []), RANKS, P.PATTERN).count() == 0
    twice = docs(spark, ["one two"]).union(docs(spark, ["one two"])).union(docs(spark, ["x"]).withColumn("doc_id", F.lit(None).cast("long")))
    assert [len(r["token_ids"]) for r in tokenization.encode(twice, RANKS, P.PATTERN).collect()] == [2, 2, 1]
