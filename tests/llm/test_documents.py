"""Operators over documents, each against a plain statement of what it should do."""

import gc
import hashlib
import re
import struct
import tracemalloc
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F, types as T
from tokenizers import Tokenizer

from veilframe.llm import mixing, packing, tokenizers_fast
from veilframe.llm.common import BATCH_BYTES, small_batches
from veilframe.llm.components import connected_components
from veilframe.llm.exact_dedup import _misra_gries, drop_exact_duplicates, exact_duplicates
from veilframe.llm.minhash import MinMax, bands_for, drop_near_duplicates, link_forest, near_duplicates, shingle_set
from veilframe.llm.mixing import copies, mix, mixed_words, source_targets
from veilframe.llm.packing import pack_lengths, packed_documents, packed_sequences
from veilframe.llm.token_counts import token_counts
from veilframe.llm.tokenizers_fast import BYTE_CHARS, IdWriter, plan

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
# names that operators use inside, and one that needs quoting
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("source", T.StringType()),
                       T.StructField("digest", T.StringType()), T.StructField("row", T.LongType()), T.StructField("size", T.StringType()),
                       T.StructField("odd `name", T.StringType())])


def frame(spark, rows):
    return spark.createDataFrame([(i, text, source, "d", 1, "s", "o") for i, text, source in rows], SCHEMA)


def words(n, seed, vocabulary=400):
    draw = np.random.default_rng(seed)
    return " ".join(f"w{x}" for x in draw.integers(0, vocabulary, n))


@pytest.fixture(scope="module")
def rows():
    base = words(120, 1)
    changed = base.split()
    changed[7] = "other"
    found = [(10, base, "a"), (3, base.replace(" ", "  \n"), "a"), (11, base, None), (12, base.upper(), "b"), (13, " ".join(changed), "b"),
             (1, None, "a"), (2, "", None), (4, " \t ", "b"), (None, "no id", "c"), (None, "no id", "c"), (14, "same row", "c"), (14, "same row", "c"),
             (15, "short", "a"), (16, "short", "b"), (17, words(30_000, 2, 5000), "b")]
    return found + [(100 + k, words(60 + k, 50 + k), "abc"[k % 3]) for k in range(40)]


def test_exact_duplicates(spark, rows):
    for counters, share in ((1024, 1 / 1024), (2, 1.0), (2, 0.0)):
        got = exact_duplicates(frame(spark, rows), counters=counters, share=share).collect()
        assert len(got) == len(rows)
        groups = defaultdict(list)
        for i, text, _ in rows:
            groups[hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", text or "").encode()).hexdigest()].append(i)
        assert Counter(r["text_sha256"] for r in got) == Counter({k: len(v) for k, v in groups.items()})
        for digest, ids in groups.items():
            mine = [r for r in got if r["text_sha256"] == digest]
            keep = min((i for i in ids if i is not None), default=None)
            assert {(r["keep_id"], r["group_size"]) for r in mine} == {(keep, len(ids))}
            assert [r["doc_id"] for r in mine if r["kept"]] == [keep]
        kept = drop_exact_duplicates(frame(spark, rows), counters=counters, share=share)
        assert kept.columns == SCHEMA.fieldNames()
        assert Counter(r["doc_id"] for r in kept.collect()) == Counter(r["doc_id"] for r in got if r["kept"])


def test_misra_gries_finds_the_frequent():
    import pyarrow as pa

    draw = np.random.default_rng(4)
    stream = [b"hot"] * 400 + [b"warm"] * 150 + [str(x).encode() for x in draw.integers(0, 10_000, 450)]
    draw.shuffle(stream)
    batches = [pa.RecordBatch.from_pydict({"digest": pa.array(stream[k:k + 90], pa.binary())}) for k in range(0, 1000, 90)]
    (found,) = _misra_gries(8)(iter(batches))
    held = dict(zip(found["digest"].to_pylist(), found["n"].to_pylist()))
    assert len(held) <= 8 and 400 - 1000 / 9 <= held[b"hot"] <= 400 and held[b"warm"] <= 150


def test_empty_tables(spark):
    none = frame(spark, [])
    for result in (exact_duplicates(none), drop_exact_duplicates(none), near_duplicates(none), drop_near_duplicates(none), mixed_words(none), mix(none),
                   token_counts(none, BYTE), packed_documents(none, WORD)):
        assert result.count() == 0


def brute_components(rows, link):
    sets = {}
    for k, (_, text, _) in enumerate(rows):
        held = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
        sets[k] = {tuple(held[j:j + 5]) for j in range(max(1, len(held) - 4))} if held else set()
    label = {k: k for k in sets}

    def find(k):
        while label[k] != k:
            k = label[k]
        return k

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b]:
                shared = len(sets[a] & sets[b])
                if link[1] * shared >= link[0] * (len(sets[a]) + len(sets[b]) - shared):
                    label[find(b)] = find(a)
    members = defaultdict(list)
    for k in sets:
        members[find(k)].append(k)
    return sets, [members[find(k)] for k in sets]


@pytest.mark.parametrize("link", [(85, 100), (80, 100)])
def test_near_duplicates(spark, rows, link):
    near = list(rows)
    for k in range(12):  # a chain: neighbours are linked, its ends are not
        text = words(200, 900).split()
        text[k * 3:k * 3 + 3] = ["x", f"y{k}", "z"]
        near.append((500 + k, " ".join(text[: 190 + k]), "a"))
    sets, members = brute_components(near, link)
    got = near_duplicates(frame(spark, near), link=link)
    assert got.columns[:4] == ["doc_id", "n_shingles", "component_id", "kept"]
    found = defaultdict(list)
    for r in got.collect():
        found[r["doc_id"]].append((r["n_shingles"], r["component_id"], r["kept"]))
    for k, (i, _, _) in enumerate(near):
        ids = [near[j][0] for j in members[k] if near[j][0] is not None]
        smallest = min(ids, default=None) if sets[k] else i
        assert (len(sets[k]), smallest, i == smallest) in found[i]
    left = drop_near_duplicates(frame(spark, near), link=link)
    assert left.columns == SCHEMA.fieldNames()
    assert left.count() == len({min(m) for k, m in enumerate(members) if sets[k]}) + sum(not s for s in sets.values())


def test_min_max_is_unbiased_and_bands_catch():
    draw = np.random.default_rng(3)
    pool = draw.integers(0, 1 << 63, 3000).astype(np.uint64)
    a, b = np.unique(pool[:2000]), np.unique(pool[1000:])
    true = 1000 / 3000
    hasher = MinMax(8, 125)
    agree = (hasher.signature(a) == hasher.signature(b)).mean()
    assert abs(agree - true) < 0.05
    assert (1 - 0.85 ** 7) ** bands_for((85, 100)) < 1.1e-6


def test_shingles_and_long_slices(monkeypatch):
    from veilframe.llm import minhash

    text = words(4000, 8).encode()
    whole = shingle_set(text)
    held = text.split()
    assert len(whole) == len({tuple(held[k:k + 5]) for k in range(len(held) - 4)})
    monkeypatch.setattr(minhash, "SLICE", 100)
    assert (shingle_set(text) == whole).all()
    assert len(shingle_set(b"a b")) == 1 and len(shingle_set(b"")) == 0


def test_link_forest_misses_no_link():
    draw = np.random.default_rng(5)
    base = np.unique(draw.integers(0, 1 << 62, 120).astype(np.uint64))
    sets = []
    for _ in range(60):
        keep = base[draw.random(len(base)) > draw.random() * 0.2]
        sets.append(np.unique(np.concatenate((keep, draw.integers(0, 1 << 62, draw.integers(0, 12)).astype(np.uint64)))))
    edges = link_forest(list(range(60)), sets, (85, 100))
    label = list(range(60))
    for a, b in edges:
        label = [label[a] if x == label[b] else x for x in label]
    for a in range(60):
        for b in range(a):
            shared = len(np.intersect1d(sets[a], sets[b]))
            if 100 * shared >= 85 * (len(sets[a]) + len(sets[b]) - shared):
                assert label[a] == label[b]
    assert len(edges) == 60 - len(set(label))


def test_connected_components(spark):
    edges = [(k + 1, k) for k in range(40)] + [(100, 101), (101, 102), (102, 100), (200, 200)]
    got = dict(connected_components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**{k: 0 for k in range(41)}, 100: 100, 101: 100, 102: 100}


def test_targets_stop_at_the_cap(spark):
    sizes = [("a", 10), ("b", 1000), ("c", 5), ("d", 300), (None, 200)]
    got = {r["source"]: r["target"] for r in source_targets(spark.createDataFrame(sizes, "source string, size long")).collect()}
    weight, size = {"a": 1, "b": 2, "c": 3, "d": 1, None: 2}, dict(sizes)
    stopped = set()
    while True:
        left = sum(size.values()) - sum(3 * size[s] for s in stopped)
        share = left / sum(w for s, w in weight.items() if s not in stopped)
        more = {s for s in weight if s not in stopped and weight[s] * share > 3 * size[s]}
        if not more:
            break
        stopped |= more
    for s in weight:
        assert got[s] == pytest.approx(3 * size[s] if s in stopped else weight[s] * share)


def test_mix(spark, rows):
    got = mixed_words(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    count = {i: len(re.findall(r"[^\x20\x09-\x0D]+", text or "")) for i, text, _ in rows}
    assert all(r["size"] == count[r["doc_id"]] and 0 <= r["taken"] <= 3 * r["size"] for r in got)
    again = mixed_words(frame(spark, rows[::-1]).repartition(5)).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))
    regular = frame(spark, [(k, words(20 + k % 50, k), "abcd"[k % 4 if k % 7 else 0]) for k in range(400)])
    by = defaultdict(lambda: [0, 0.0])
    for r in copies(regular).collect():
        by[r["source"]][0] += r["copies"] * r["size"]
        by[r["source"]][1] = r["target"]
    assert all(abs(taken - target) <= 1 for taken, target in by.values())
    mixed = mix(regular)
    assert mixed.columns == regular.columns
    assert Counter(r["doc_id"] for r in mixed.collect()) == Counter({r["doc_id"]: r["copies"] for r in copies(regular).collect() if r["copies"]})


def _sampled(docs, ratio, target, near, places):
    """Order sampling read from its definition: the draws ``{place: size}``, taken down the order, the last places by trying all subsets."""
    order = sorted(docs)
    goal = round(target) - int(ratio) * sum(docs.values())
    taken, left, limit = [], goal, goal
    for p in order:
        if docs[p] > limit:
            continue
        if docs[p] > left:
            limit = left
            if left <= target * near:
                break
            continue
        taken.append(p)
        left -= docs[p]
    last = taken[-places:]
    need = left + sum(docs[p] for p in last)
    others = [p for p in order if p not in set(taken) and docs[p] <= need][:places]
    gap = min(abs(need - sum(c)) for k in range(len(last + others) + 1) for c in combinations([docs[p] for p in last + others], k))
    return set(taken[:-places]), set(last + others), gap


def test_mix_matches_plain_order_sampling(spark, monkeypatch):
    monkeypatch.setattr(mixing, "LAST_PLACES", 4)
    draw = np.random.default_rng(8)
    sizes = [[400] * 300 + [100_000], list(draw.integers(1, 2000, 150)), list((draw.pareto(0.7, 200) * 5 + 1).astype(int)), [7] * 5]
    table = [(1000 * s + k, " ".join(["w"] * int(n)), "abcd"[s]) for s, group in enumerate(sizes) for k, n in enumerate(group)]
    docs = frame(spark, table)
    got = {r["doc_id"]: r for r in copies(docs).collect()}
    digest = {r[0]: r[1] for r in docs.select("doc_id", mixing._digest(F.col("doc_id"), F.col("text"))).collect()}
    for source in "abcd":
        mine = {i: r["size"] for i, r in got.items() if r["source"] == source}
        target = next(r["target"] for r in got.values() if r["source"] == source)
        ratio = target / sum(mine.values())
        part = ratio - int(ratio)
        # without importance the order by rank is the order of the uniform numbers
        place = {((digest[i] & (1 << 64) - 1) >> 12, digest[i]): i for i in mine}
        sure, weighed, gap = _sampled({p: mine[i] for p, i in place.items()}, ratio, target, mixing.NEAR, 4) if part else (set(), set(), 0)
        extra = {i for i in mine if got[i]["copies"] > int(ratio)}
        assert {place[p] for p in sure} - {place[p] for p in weighed} <= extra <= {place[p] for p in sure | weighed}
        assert abs(sum(r["copies"] * mine[i] for i, r in got.items() if i in mine) - round(target)) == gap


def test_mix_passes_over_long_documents(spark):
    for seed in range(3):
        docs = frame(spark, [(k, f"s{seed} " + "w " * 399, "a") for k in range(1000)] + [(5000, f"s{seed} " + "w " * 99_999, "a")]
                     + [(7000 + k, "w " * 5000, "b") for k in range(80)])
        got = mixed_words(docs).collect()
        for source in (range(0, 6000), range(7000, 8000)):
            mine = [r for r in got if r["doc_id"] in source]
            assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) <= (400 if source[0] == 0 else 5000)


def test_mix_gives_rows_without_id_their_own_draws(spark):
    docs = frame(spark, [(None, words(30 + k % 20, k), "a") for k in range(3000)] + [(1, words(90_000, 5), "b")] + [(None, "same row", "a")] * 2)
    by = defaultdict(lambda: [0, 0.0])
    for r in copies(docs).collect():
        by[r["source"]][0] += r["copies"] * r["size"]
        by[r["source"]][1] = r["target"]
    assert abs(by["a"][0] - by["a"][1]) <= 60


TEXTS = ["", " ", "  ", "\n", "a", " a", "a ", "a  ", "a \n b", "don't  stop", "x²½ ñandú", "ΑΣ Σ", "é é", "中文 mixed 文", "😀 ok", "tab\tsep\r\n",
         "end <|endoftext|> of", "\x1c\x85\xa0x", "word " * 3000, "a" * 5000, "1234567 89", "___ a_b", "'s 're it's", "ﬁx İ"]


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_ids_are_the_librarys(path):
    library, own = Tokenizer.from_file(path), IdWriter(plan(path))
    draw = np.random.default_rng(9)
    alphabet = list("aB1!' _éßΣ²\n\t  .,")
    for text in TEXTS + ["".join(draw.choice(alphabet, draw.integers(0, 25))) for _ in range(1500)]:
        want = library.encode(text, add_special_tokens=False).ids
        assert own.of_text(text) == struct.pack(f"<{len(want)}I", *want), repr(text)


@pytest.mark.parametrize("stretch", [300, 8 << 20])
@pytest.mark.parametrize("path", [BYTE, WORD])
def test_ids_of_a_column_are_the_librarys(path, stretch, monkeypatch):
    monkeypatch.setattr(tokenizers_fast, "STRETCH", stretch)
    library, own = Tokenizer.from_file(path), IdWriter(plan(path))
    draw = np.random.default_rng(10)
    alphabet = list("aB1!' _éßΣ²\n\t  .,\0")
    texts = [None, *TEXTS, "a\0b c", "x\n\n", "two  spaces", "İstanbul"] + ["".join(draw.choice(alphabet, draw.integers(0, 25))) for _ in range(1500)]
    ids, counts = own.of_column(pa.array(texts))
    for text, got in zip(texts, np.split(ids, np.cumsum(counts)[:-1])):
        assert got.tolist() == library.encode(text or "", add_special_tokens=False).ids, repr(text)
    assert [len(x) for x in own.of_column(pa.array([], pa.string()))] == [0, 0]


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_unseen_words_are_merged_without_the_librarys_model(path):
    library, own = Tokenizer.from_file(path), IdWriter(plan(path))
    own.model = None
    draw = np.random.default_rng(11)
    texts = [" ".join("".join(draw.choice(list("aeinrstñé"), draw.integers(1, 16))) for _ in range(40)) for _ in range(50)]
    ids, _ = own.of_column(pa.array(texts))
    assert ids.tolist() == [x for text in texts for x in library.encode(text, add_special_tokens=False).ids]


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_what_is_remembered_of_words_is_small(path):
    letters = str.maketrans("0123456789", "qwertyuiop")
    own = IdWriter(plan(path))
    texts = pa.array([" ".join(str(n).translate(letters) for n in range(k, k + 200)) for k in range(100_000, 200_000, 200)])
    gc.collect()
    tracemalloc.start()
    arrow = pa.total_allocated_bytes()
    own.of_column(texts)
    gc.collect()
    held = tracemalloc.get_traced_memory()[0] + pa.total_allocated_bytes() - arrow
    tracemalloc.stop()
    assert len(own.known) >= 99_000 and held < 80 * len(own.known), held


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_ids_are_gathered_for_some_stretches_at_a_time(path, monkeypatch):
    texts = pa.array([None, *TEXTS, "x\n\n", "two  spaces"] + ["the cat sat on the mat " * k for k in range(60)])
    whole = IdWriter(plan(path)).of_column(texts)
    monkeypatch.setattr(tokenizers_fast, "GATHER", 7)
    for want, got in zip(whole, IdWriter(plan(path)).of_column(texts)):
        assert want.tolist() == got.tolist()


def test_packing_holds_neither_a_batch_of_ids_nor_what_was_remembered(monkeypatch):
    monkeypatch.setattr(tokenizers_fast, "STRETCH", 1 << 18)
    pieces = packing.piece_column(WORD, ids=False).func
    texts = pa.array(["the cat sat on the mat " * 800] * 500)      # 9 MB
    list(pieces(iter([texts.slice(0, 1)])))     # the encoder is made
    gc.collect()
    tracemalloc.start()
    found, = pieces(iter([texts]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    ids = 4 * pc.sum(pc.struct_field(found.flatten(), "length")).as_py()
    assert ids > 9 << 20 and peak < ids, (peak, ids)
    encoder = tokenizers_fast.shared_encoder(IdWriter, plan(WORD))
    assert not len(encoder.known) and not len(encoder.flat) and not any((encoder.pieces, encoder.plain, encoder.spaced))


def test_packing_gives_python_small_batches(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    with small_batches(spark):
        assert int(spark.conf.get(key).rstrip("b")) == BATCH_BYTES
    assert spark.conf.get(key) == before
    spark.conf.set(key, "1000000")
    try:
        with small_batches(spark):     # the session's own size stays
            assert spark.conf.get(key).rstrip("b") == "1000000"
    finally:
        spark.conf.unset(key)


def test_whole_tokens_are_proven():
    library, settled = Tokenizer.from_file(BYTE), plan(BYTE)
    assert " the" in settled.whole and len(settled.whole) > 40_000 and len(BYTE_CHARS) == 256
    for text in sorted(settled.whole)[::500]:
        assert len(library.encode(text, add_special_tokens=False).ids) == 1


def test_token_counts(spark, rows):
    library = Tokenizer.from_file(BYTE)
    texts = [(k, text, "a") for k, text in enumerate([*TEXTS, None])] + rows
    got = token_counts(frame(spark, texts), BYTE).collect()
    want = Counter()
    for i, text, _ in texts:
        n = len(library.encode(text or "", add_special_tokens=False).ids)
        want[(i, len((text or "").encode()), n, n > 512)] += 1
    assert Counter(map(tuple, got)) == want


def check_packing(pieces, texts, capacity):
    library = Tokenizer.from_file(WORD)
    by_sequence = defaultdict(list)
    for r in pieces:
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    want = Counter()
    for i, text in texts:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), capacity):
            part = ids[k:k + capacity]
            want[(i, k // capacity, k, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part)))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in pieces) == want
    return len(by_sequence), sum(r["length"] for r in pieces)


def test_packing(spark, rows):
    docs = frame(spark, rows)
    n, total = check_packing(packed_documents(docs, WORD).collect(), [(i, t) for i, t, _ in rows], 2048)
    assert n <= -(-total // 2048) + 1
    n, total = check_packing(packed_documents(docs, WORD, length=300, shard_pieces=20).collect(), [(i, t) for i, t, _ in rows], 300)
    sequences = packed_sequences(docs, WORD, length=300, shard_pieces=20).collect()
    assert len(sequences) == n and sum(r["n_tokens"] for r in sequences) == total
    assert all(len(r["ids"]) == 4 * r["n_tokens"] for r in sequences)


def test_swaps_empty_sequences():
    draw = np.random.default_rng(2)
    for sizes in (draw.integers(1, 100, 500), np.array([60] * 10 + [40] * 10), np.array([100] * 5), np.array([51] * 7 + [49, 30, 19] * 6), np.array([], int)):
        where, offset, n = pack_lengths(sizes, 100)
        fill = np.bincount(where, sizes, n) if len(sizes) else np.zeros(0)
        assert (fill <= 100).all() and (fill > 0).all()
        assert n <= max(-(-int(sizes.sum()) // 100) * 1.05 + 1, (sizes > 50).sum()) if len(sizes) else n == 0
