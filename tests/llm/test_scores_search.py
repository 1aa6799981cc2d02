"""Classifiers, URL rules, search, token files and the pipeline."""

import math
import re
import struct
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F, types as T
from tokenizers import Tokenizer

import corpus_pipeline
from veilframe.llm import queries, sql
from veilframe.llm.quality import held_out, keep_good, quality_scores
from veilframe.llm.rangecoder import decode_ids, encode_ids, open_block, pack_block
from veilframe.llm.text_stats import STATS, text_stats
from veilframe.llm.token_output import FILE_COLUMNS, combine_crc32, read_ids, round_trip, write_ids
from veilframe.llm.toxicity import Decoder, Reader, letter_model, toxicity_scores
from veilframe.llm.url_filter import RULES, allowed_pages, judge_urls
from veilframe.llm.vptree import Tree, distances, nearest

FOLDER = "/root/testdata/sf0.001"
LARGER = "/root/testdata/sf0.01"
BYTE = public_tokenizers.path("byte_bpe_50k.json")


def table(spark, name, folder=FOLDER):
    return spark.read.parquet(f"{folder}/{name}.parquet")


@pytest.fixture(scope="module")
def odd_docs(spark):
    """Nulls, empty texts, repeated rows, a very long text, and columns with clashing names."""
    rows = [(None, None), (1, None), (2, ""), (3, " \n"), (3, " \n"), (4, "plain words here. " * 30_000), (4, "other text"), (None, "no id")]
    return spark.createDataFrame([(i, t, 1.0, "x", "y") for i, t in rows], "doc_id long, text string, score double, stats string, y string")


def ranks(scores, labels):
    order = scores.rank()
    n = labels.sum()
    return (order[labels == 1].sum() - n * (n + 1) / 2) / (n * (len(labels) - n))


@pytest.mark.parametrize("scores, label, least", [(quality_scores, "quality", 0.98), (toxicity_scores, "toxic", 0.9)])
def test_held_out_accuracy(spark, scores, label, least):
    docs, labels = table(spark, "documents", LARGER), table(spark, "labels", LARGER)
    got = scores(docs, labels).toPandas()
    assert len(got) == docs.count() and got.score.between(0, 1).all()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in got.doc_id]).all()
    seen = got.merge(labels.toPandas(), on="doc_id")
    unseen = seen[seen.held_out]
    assert (unseen.predicted == unseen[label]).mean() > 0.95
    assert ranks(unseen.score, unseen[label]) > least


@pytest.mark.parametrize("scores, label", [(quality_scores, "quality"), (toxicity_scores, "toxic")])
def test_scores_of_odd_documents(spark, odd_docs, scores, label):
    labels = table(spark, "labels")
    both = table(spark, "documents").select("doc_id", "text")
    learnt = scores(both.unionByName(odd_docs.select(F.col("doc_id") + 10_000_000, "text").toDF("doc_id", "text")), labels).where(
        F.col("doc_id").isNull() | (F.col("doc_id") > 9_000_000)).collect()
    assert len(learnt) == odd_docs.count() and all(0 <= r["score"] <= 1 for r in learnt)
    assert len({r["score"] for r in learnt if r["doc_id"] in (10_000_001, 10_000_002, 10_000_003)}) == 1
    none = labels.limit(0)
    assert len({r["score"] for r in scores(odd_docs, none).collect()}) == 1
    assert scores(odd_docs.limit(0), labels).count() == 0
    strange = spark.createDataFrame([(1, None), (2, 7), (None, 1)], f"doc_id long, {label} int")
    assert scores(odd_docs, strange).count() == odd_docs.count()


def test_labels_are_learnt_from_the_allowed_rows_only(spark):
    docs, labels = table(spark, "documents", LARGER), table(spark, "labels", LARGER)
    turned = labels.withColumn("quality", F.when(held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert sorted(quality_scores(docs, labels).collect()) == sorted(quality_scores(docs, turned).collect())


def test_keep_good_keeps_columns(spark, odd_docs):
    kept = keep_good(odd_docs, table(spark, "labels").limit(0))
    assert kept.columns == odd_docs.columns and kept.count() == odd_docs.count()


def test_text_stats(monkeypatch):
    from veilframe.llm import text_stats as module

    text = "Some words, again words.\nSome LOUD!! lines | 12 ###\nSome LOUD!! lines | 12 ###".encode()
    whole = dict(zip(STATS, text_stats(text)))
    n = len(text.split())
    assert whole["log_words"] == pytest.approx(math.log1p(n)) and whole["distinct_words"] == pytest.approx(len(set(text.split())) / n)
    assert whole["repeated_lines"] == pytest.approx(1 / 3) and whole["pipe_words"] == pytest.approx(2 / n)
    assert not text_stats(b" \n").any()
    monkeypatch.setattr(module, "SLICE", 10)
    sliced = dict(zip(STATS, text_stats(text)))
    for name in ("log_words", "word_length", "upper", "lines", "shout_words", "letter_entropy"):
        assert sliced[name] == pytest.approx(whole[name])


@pytest.mark.parametrize("written, meant", [("1d10t", "idiot"), ("p@th3t1c", "pathetic"), ("looooser", "loser"), ("tr4sh", "trash"), ("s_t_u_p_i_d", "stupid"),
                                            ("m.o.r.o.n", "moron"), ("$cum", "scum"), ("cl*wn", "clown")])
def test_decoding(spark, written, meant):
    texts = ["an idiot and a pathetic loser in the trash", "stupid moron scum and worthless clown", "the reading of the then and other things"] * 20
    costs = letter_model(spark.createDataFrame([(t,) for t in texts], "text string"))
    assert Decoder(costs).restore(written) == meant


@pytest.mark.parametrize("text, hidden", [("what a l o s e r", "loser"), ("you are a m o r o n", "moron"), ("m   o   r   o   n", "moron"), ("you m o r o n   l o s e r", "loser"),
                                          ("m / o / r / o / n", "moron"), ("t,r,a,s,h", "trash"), ("lloser", "loser"), ("idiiot", "idiot"), ("you/moron", "moron"), ("tr:ash", "trash"),
                                          ("(l o s e r)", "loser"), ("stuupid", "stupid"), ("a stupid loser", "stupid")])
def test_hidden_words_are_read(spark, text, hidden):
    texts = ["an idiot and a pathetic loser in the trash", "stupid moron scum and worthless clown", "the reading of the then and other things"] * 20
    costs = letter_model(spark.createDataFrame([(t,) for t in texts], "text string"))
    reader = Reader(costs)
    word = reader._entries(hidden)[0]
    assert any(set(word) <= set(read) for read in reader.of_text(text))


def test_hidden_words_are_caught(spark):
    plain = table(spark, "documents", LARGER)
    clean = [r["text"] for r in plain.where("lang = 'en'").limit(30).collect()]
    hidden = [(5_000_000 + k, f"{t[:200]} what an 1d10t and p@thetic l o s e r you are, tr4sh!") for k, t in enumerate(clean)]
    docs = plain.select("doc_id", "text").unionByName(spark.createDataFrame(hidden, "doc_id long, text string"))
    got = toxicity_scores(docs, table(spark, "labels", LARGER)).where("doc_id >= 5000000").toPandas()
    assert got.predicted.mean() > 0.9


def test_words_set_apart_beside_others_are_caught(spark):
    plain = table(spark, "documents", LARGER)
    clean = [r["text"] for r in plain.where("lang = 'en'").limit(30).collect()]
    forms = ["you are a m o r o n and a l o s e r, a i d i o t", "m   o   r   o   n and l   o   s   e   r and i   d   i   o   t", "what a moroon, a llosser, an iddiot"]
    hidden = [(5_000_000 + k, f"{t[:200]} {forms[k % 3]}") for k, t in enumerate(clean)]
    docs = plain.select("doc_id", "text").unionByName(spark.createDataFrame(hidden, "doc_id long, text string"))
    got = toxicity_scores(docs, table(spark, "labels", LARGER)).where("doc_id >= 5000000").toPandas()
    assert got.predicted.mean() > 0.9


def by_rules(url):
    if not url or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host):]).group()
    host = re.sub("[A-Z]", lambda m: m.group().lower(), host)
    fits = [(h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fits, key=lambda x: len(x[0])) if fits else (None, None))


URLS = [None, "", "no scheme", "http://", "https://WWW.Example.COM/en/x?y=1#z", "http://a.example.com/en/", "http://example.com/en", "http://net/es/1",
        "ftp://x.net/fr/", "http://xnet/fr/", "http://b.example.org/a/b/c.html", "http://c.net?q", "http://d.com#x", "x://y://com/", "http://é.com/ü",
        "http://long.example.org/" + "a/" * 20_000, "http://a\n.com/b\nc"]


def test_url_rules(spark):
    docs = spark.createDataFrame([(k, u, "h", "r") for k, u in enumerate(URLS * 3)] + [(None, URLS[5], "h", "r")], "page_id long, url string, host string, rule string")
    got = judge_urls(docs)
    assert got.columns[:5] == ["page_id", "host", "path", "rule", "verdict"]
    for r in got.collect():
        host, path, rule, verdict = by_rules(URLS[r["page_id"] % len(URLS)] if r["page_id"] is not None else URLS[5])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule) and r["verdict"] in ("allow", "block")
        assert verdict is None or r["verdict"] == verdict
    allowed = allowed_pages(docs)
    assert allowed.columns == docs.columns and allowed.count() == got.where("verdict = 'allow'").count()
    assert judge_urls(docs.limit(0)).count() == 0
    assert {r["verdict"] for r in judge_urls(docs, rules=()).collect()} == {"allow"}


def test_trees_learn_from_labelled_urls(spark):
    draw = np.random.default_rng(1)
    pages = [(k, f"http://{'spam' if k % 2 else 'news'}{draw.integers(9)}.example.org/{'x' * int(draw.integers(3, 9))}{'/9876543210?a=1&b=2' if k % 2 else '/story'}")
             for k in range(600)]
    docs = spark.createDataFrame(pages, "page_id long, url string")
    labelled = docs.where("page_id < 300").select("url", (F.col("page_id") % 2).alias("blocked"))
    got = judge_urls(docs, rules=(), labelled=labelled).where("page_id >= 300").toPandas()
    assert ((got.verdict == "block") == (got.page_id % 2 == 1)).mean() > 0.98


def brute(ids, vectors, k, every=100):
    found = []
    for i in ids[ids % every == 0]:
        d = distances(vectors[ids == i][:1], vectors)[0]
        other = ids != i
        order = np.lexsort((ids[other], d[other]))[:k]
        found += [(int(i), n + 1, int(ids[other][j]), float(d[other][j])) for n, j in enumerate(order)]
    return found


def test_nearest_is_exact_with_factor_one(spark):
    draw = np.random.default_rng(7)
    centres = draw.normal(0, 10, (8, 6))
    vectors = centres[draw.integers(0, 8, 1500)] + draw.normal(0, 1, (1500, 6))
    vectors[200:260] = vectors[200]     # equal vectors: ties go to the smaller id
    ids = np.arange(1500) * 5
    rows = [(int(i), [float(x) for x in v]) for i, v in zip(ids, vectors)]
    odd = [(100_000, None), (100_100, [0.0] * 6), (100_200, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (100_300, [float("nan")] + [1.0] * 5),
           (100_400, [float("inf")] + [1.0] * 5), (None, [1.0] * 6), (100_500, [1.0, 2.0])]
    frame = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>")
    want = brute(ids, vectors, 10)
    for options in ({}, {"shard_rows": 200, "block_rows": 4, "leaf": 8}):
        got = sorted(tuple(r) for r in nearest(frame, factor=1.0, **options).collect())
        assert [g[:3] for g in got] == [w[:3] for w in sorted(want)]
        assert np.allclose([g[3] for g in got], [w[3] for w in sorted(want)], rtol=0, atol=0)
    assert nearest(frame.limit(0)).count() == 0
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (1, [0.0, 2.0])], "vec_id long, embedding array<double>")
    assert [tuple(r)[:3] for r in nearest(few).collect()] == [(0, 1, 1)]


def test_repeated_rows_are_one_candidate(spark):
    draw = np.random.default_rng(5)
    ids, vectors = np.arange(1, 121), draw.normal(0, 1, (120, 4))
    query = draw.normal(0, 1, 4)
    near = np.argsort(distances(query[None], vectors)[0], kind="stable")
    rows = [(0, query)] * 3 + list(zip(ids, vectors))
    rows += [(ids[near[0]], vectors[near[0]])] * 30                                     # more copies than k
    rows += [(ids[near[3]], vectors[near[3]])]
    rows += [(ids[near[1]], vectors[near[1]] + (n + 1) * 1e-6) for n in range(15)]      # one id, many vectors
    want = {}
    for i, v in rows:
        d = float(distances(query[None], v[None])[0, 0])
        want[int(i)] = min(d, want.get(int(i), d))
    del want[0]
    want = sorted((d, i) for i, d in want.items())
    frame = spark.createDataFrame([(int(i), [float(x) for x in v]) for i, v in rows], "vec_id long, embedding array<double>")
    asked = frame.where("vec_id = 0")
    for options in ({"k": 10}, {"k": 10, "shard_rows": 40, "leaf": 4}, {"k": 200}):
        got = nearest(frame, asked, factor=1.0, **options).orderBy("rank").collect()
        assert [(r["score"], r["vec_id"]) for r in got] == want[:options["k"]]
        assert [r["rank"] for r in got] == list(range(1, len(got) + 1))


def test_recall_of_relaxed_pruning(spark):
    frame = table(spark, "embeddings", LARGER)
    rows = frame.collect()
    ids, vectors = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], float)
    want = {w[:1] + w[2:3] for w in brute(ids, vectors, 10)}
    got = {(r["query_id"], r["vec_id"]) for r in nearest(frame, leaf=16).collect()}
    assert len(got & want) / len(want) >= 0.9
    tree, exact = Tree(ids, vectors, 16), Tree(ids, vectors, 1000)
    own = ids[:20]
    assert np.array_equal(tree.search(vectors[:20], own, 5, 1.0)[1], exact.search(vectors[:20], own, 5, 1.0)[1])


@pytest.mark.parametrize("make", [lambda d: np.zeros(0, int), lambda d: np.array([7]), lambda d: d.integers(0, 50_257, 3000), lambda d: np.minimum(d.zipf(1.2, 20_000), 50_000),
                                  lambda d: np.tile(d.integers(0, 60_000, 100), 80), lambda d: np.zeros(9000, int), lambda d: d.integers(0, 1 << 20, 50)])
def test_range_coder_round_trip(make):
    ids = make(np.random.default_rng(3))
    block = pack_block(ids, b"table")
    back, table_ = open_block(block)
    assert np.array_equal(back, ids) and table_ == b"table"
    if len(ids) > 100:
        broken = bytearray(block)
        broken[-5] ^= 1
        with pytest.raises(ValueError):
            open_block(bytes(broken))


def test_what_repeats_gets_short():
    ids = np.tile(np.random.default_rng(1).integers(0, 50_000, 200), 400)
    assert len(encode_ids(ids, 50_000)) < len(ids) / 2
    assert np.array_equal(decode_ids(encode_ids(ids, 50_000), len(ids), min(4096, len(ids) // 64), 50_000), ids)


def test_early_steps_count():
    # texts change their ids' shares most at the beginning, so that is where the tables have to be made anew
    ids = np.minimum(np.random.default_rng(8).zipf(1.3, 60_000), 50_000)
    assert len(encode_ids(ids, 50_001)) * 8 / len(ids) < 8.2


def test_joined_checksums():
    a, b = b"first part", b"and the second"
    assert combine_crc32(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


def test_token_files(spark, tmp_path):
    library = Tokenizer.from_file(BYTE)
    texts = [(5, "some text"), (1, None), (2, ""), (9, "long " * 4000), (7, "x"), (None, "no id")]
    docs = spark.createDataFrame([(i, t, 0) for i, t in texts], "doc_id long, text string, start int")
    want, at = [], 0
    for i, t in sorted(texts, key=lambda x: (x[0] is not None, x[0] or 0)):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((i, at, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        at += len(ids)
    for options in ({}, {"block_ids": 700, "parts": 2}, {"block_ids": 1, "parts": 1} if at < 100 else {"block_ids": 4001, "parts": 3}):
        got = sorted(map(tuple, round_trip(docs, BYTE, **options).collect()), key=lambda r: r[1])
        assert got == want
    write_ids(docs, str(tmp_path / "files"), BYTE)
    back = read_ids(spark.read.schema(FILE_COLUMNS).parquet(str(tmp_path / "files"))).collect()
    assert Counter(len(r["ids"]) // 4 for r in back) == Counter(w[2] for w in want)
    assert round_trip(docs.limit(0), BYTE).count() == 0
    twice = round_trip(docs.unionByName(docs), BYTE, block_ids=999).collect()
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in twice) == Counter({(w[0], w[2], w[3]): 2 for w in want})


def test_queries_and_their_sql(spark):
    import duckdb

    names = {name.split("_")[0] for name in queries.QUERIES}
    assert names == {f"op{n}" for n in range(1, 11)}
    con = duckdb.connect()
    for name in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{FOLDER}/{name}.parquet')")
    for name, text in queries.SQL.items():
        got = queries.QUERIES[name](spark, FOLDER)
        cursor = con.execute(text)
        columns = [d[0] for d in cursor.description]
        assert sorted(map(tuple, got.select(columns).collect())) == sorted(cursor.fetchall())


def test_pipeline(spark):
    assert [k for k, _ in corpus_pipeline.STAGES] == ["quality classifier", "exact dedup", "near dedup", "source mix", "packing"]
    docs = table(spark, "documents", LARGER)
    labels = {r["doc_id"]: r["quality"] for r in table(spark, "labels", LARGER).collect()}
    columns = docs.columns
    counts = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, LARGER).toPandas(), docs.schema)
        assert docs.columns == columns
        counts.append(docs.count())
        if name == "quality classifier":
            kept = {r["doc_id"] for r in docs.collect()}
            assert all(i in kept for i, good in labels.items() if good)
            assert not any(i in kept for i, good in labels.items() if not good)
        if name in ("exact dedup", "near dedup"):
            assert docs.select("doc_id").distinct().count() == counts[-1] < counts[-2]
    result = corpus_pipeline.run(spark, LARGER)
    assert set(result.columns) == {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"}
    assert result.where("piece = 0").count() == counts[-1]


def test_stages_take_odd_documents(spark, tmp_path):
    folder = str(tmp_path)
    table(spark, "labels").write.parquet(f"{folder}/labels.parquet")
    docs = spark.createDataFrame([(None, None, None, None, None), (1, None, "en", None, 0), (1, None, "en", None, 0), (2, "one two three four five six", None, "a", 1),
                                  (3, "one two three four five six", "de", "b", 2), (4, "words and more " * 2000, "fr", "b", None)],
                                 T.StructType.fromDDL("doc_id long, text string, lang string, source string, n_chars long"))
    for frame in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            result = stage(spark, frame, folder)
            assert result.count() >= 0


def test_trees_see_a_rare_verdict_and_any_partitioning_gives_the_same(spark):
    pages = [(k, f"https://site{k % 50}.org/a{k}/page.html") for k in range(3000)] + [(3000 + k, f"https://bad.biz/x?a={k}&b=1&c=2") for k in range(5)] \
        + [(4000 + k, None) for k in range(50)] + [(5000 + k, "https://hot.org/same") for k in range(1000)]
    docs = spark.createDataFrame(pages, "page_id long, url string")
    labelled = docs.where("page_id < 4000 OR page_id >= 5000").select("url", F.col("page_id").between(3000, 3999).cast("int").alias("blocked"))
    got = judge_urls(docs, rules=(), labelled=labelled, bound=100).toPandas().sort_values("page_id")
    assert set(got[got.verdict == "block"].page_id) >= set(range(3000, 3005))
    assert (got[got.page_id < 3000].verdict == "allow").all() and (got[got.page_id >= 5000].verdict == "allow").all()
    again = judge_urls(docs.repartition(5), rules=(), labelled=labelled.repartition(3), bound=100).toPandas().sort_values("page_id")
    assert (got.score.values == again.score.values).all()
