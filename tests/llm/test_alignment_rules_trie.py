"""Token alignment, weakly supervised rules and the prefix trie against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from veilframe.llm import alignment
from veilframe.llm.alignment import alignments, diagonal_runs
from veilframe.llm.prefix_trie import prefix_trie
from veilframe.llm.tokenizers_fast import plan
from veilframe.llm.weak_rules import COUNTS, estimate, text_counts, votes, weak_quality

LEFT, RIGHT = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TEXTS = ["The quick brown fox, the quick brown fox.", "  two  spaces and a tail ", "<|endoftext|> </s> <s> are text", "Üß é́ ﬁ 　 😀😀 naïve\ttabs\n\n\nlines",
         "▁ marks are not given back", "a▁b", None, "", " ", "a", "the the the the", "1234567 12.5e-3 x_y __init__", "The quick brown fox, the quick brown fox.",
         "word " * 40_000]


def _plain_groups(a, b, size_a, size_b):
    groups, i, j, x, y = [], 0, 0, 0, 0
    left, right = [], []
    while i < len(a) or j < len(b):
        if x <= y:
            left.append(a[i])
            x += size_a[a[i]]
            i += 1
        else:
            right.append(b[j])
            y += size_b[b[j]]
            j += 1
        if x == y:
            groups.append((left, right))
            left, right = [], []
    return groups


def _plain_alignment(texts):
    tok = Tokenizer.from_file(LEFT)
    tok.encode_special_tokens = True
    pieces = sentencepiece.SentencePieceProcessor(model_file=RIGHT)
    back = {}
    chars = [*range(33, 127), *range(161, 173), *range(174, 256)]
    for b in range(256):
        back[chr(b) if b in chars else chr(256 + sum(x not in chars for x in range(b)))] = b
    as_a = lambda k: bytes(back[c] for c in tok.id_to_token(k))
    as_b = lambda k: bytes([int(pieces.id_to_piece(k)[3:5], 16)]) if pieces.is_byte(k) else pieces.id_to_piece(k).replace("▁", " ").encode()
    out = []
    for text in texts:
        a, b = (tok.encode(" " + text, add_special_tokens=False).ids, pieces.encode(text)) if text else ([], [])
        whole = (" " + (text or "")).encode()
        if b"".join(map(as_a, a)) != whole or b"".join(map(as_b, b)) != whole:
            a = b = []
        sizes_a, sizes_b = {k: len(as_a(k)) for k in a}, {k: len(as_b(k)) for k in b}
        out.append((a, b, _plain_groups(a, b, sizes_a, sizes_b)))
    count = Counter((x[-1], y[-1]) for _, _, groups in out for x, y in groups)
    best = defaultdict(int)
    for (_, y), n in count.items():
        best[y] = max(best[y], n)
    for a, b, groups in out:
        links = [(x[-1], y[-1]) for x, y in groups]
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        yield (len(a), len(b), len(groups), len(links), sum(count[p] == best[p[1]] for p in links), sum(count[p] for p in links),
               hashlib.sha256(text.encode()).hexdigest() if groups else "")


@given(st.lists(st.integers(1, 60), min_size=1, unique=True), st.lists(st.integers(1, 60), unique=True), st.integers(1, 30))
@settings(max_examples=200, deadline=None)
def test_runs_cover_every_common_end(a, b, stretch):
    tail = [100 + k for k in range(stretch)]
    a, b = sorted(a) + tail, sorted(b) + tail
    at_i = at_j = 0
    ends = []
    for i, i2, j, j2, n in diagonal_runs(a, b):
        assert (i, j) == (at_i, at_j)
        at_i, at_j = i2, j2
        assert n == 0 or (i2 - i == n == j2 - j and a[i:i2] == b[j:j2])
        ends += a[i:i2] if n else [a[i2 - 1]]
    assert ends == sorted(set(a) & set(b)) and (at_i, at_j) == (len(a), len(b))


@pytest.mark.parametrize("frequent", [1 << 18, 5, 0])
def test_alignment_equals_the_plain_one(spark, frequent):
    rows = [(k if k != 3 else None, text, k, "x") for k, text in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, pairs long, row string")
    got = alignments(docs, LEFT, RIGHT, frequent=frequent)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    want = [(r[0], *facts) for r, facts in zip(rows, _plain_alignment(TEXTS))]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_alignment_of_a_column_in_slices(monkeypatch):
    monkeypatch.setattr(alignment, "SLICE", 7)
    batch = pa.RecordBatch.from_pydict({"row": list(range(len(TEXTS))), "doc_id": list(range(len(TEXTS))), "text": [text or "" for text in TEXTS]})
    got = pa.Table.from_batches(alignment._aligned(plan(LEFT), RIGHT)(iter([batch]))).to_pylist()
    ids = list(alignment.both_ids(batch.column("text"), plan(LEFT), RIGHT))
    for mine, x, want in zip(got, ids, _plain_alignment(TEXTS), strict=True):
        assert (mine["n_a"], mine["n_b"], mine["n_groups"], mine["groups_sha256"]) == (*want[:3], want[-1])
        assert (0, 0) == want[:2] if x is None else tuple(map(len, x)) == want[:2]


def test_alignment_of_an_empty_table(spark):
    assert alignments(spark.createDataFrame([], "doc_id long, text string"), LEFT, RIGHT).collect() == []


def _plain_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4))
    places = {p for i in range(len(words) - 4) if grams[tuple(words[i:i + 5])] > 1 for p in range(i, i + 5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(places), len(lines),
            sum("A" <= c <= "Z" for c in text), len(set(words)), sum(a == b for a, b in zip(words, words[1:])), sum(c in ".!?" for c in text),
            len(re.findall(r"##|\*\*|\$\$|%%|&&|\|\||!!|\?\?", text)))


def _odd_documents():
    draw = random.Random(5)
    texts = [" ".join(draw.choice("abcde") for _ in range(draw.randrange(40))) for _ in range(60)]
    texts += ["\n".join(draw.choice(["a b", "a b ", " ", "", "Ünï x.", "b\r"]) for _ in range(draw.randrange(12))) for _ in range(40)]
    texts += [None, "", " \n\t ", "one", " not space here", "a b c d e a b c d e", "x " * 50_000, "##$$ !!! && ###"]
    return texts


def test_counts_of_texts_equal_the_plain_ones(spark):
    texts = _odd_documents()
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, words string")
    got = {r["doc_id"]: tuple(r[c] for c in COUNTS) for r in text_counts(docs).collect()}
    assert got == {k: _plain_counts(t) for k, t in enumerate(texts)}


def _prose(draw, n):
    words = ["".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(draw.randrange(3, 8))) for _ in range(n)]
    return "\n".join(" ".join(words[i:i + 12]).capitalize() + "." for i in range(0, n, 12))


def test_rules_agree_on_what_is_bad(spark):
    draw = random.Random(2)
    good = [_prose(draw, 120) for _ in range(160)]
    noisy = [" ".join(w + draw.choice(["###", "$$$", "&&&"]) for w in _prose(draw, 100).split()) for _ in range(20)]
    stuck = ["\n".join(["same line again and again here"] * 3 + [_prose(draw, 12)]) * 4 for _ in range(20)]
    texts = good + noisy + stuck + [None, "", "too short"]
    docs = spark.createDataFrame([(k if k else None, t, 1, 2) for k, t in enumerate(texts)], "doc_id long, text string, v0 int, p0 int")
    got = weak_quality(docs)
    kept = {r["doc_id"] for r in got.collect() if r["kept"]}
    assert kept == {k if k else None for k in range(len(good))}
    assert weak_quality(docs.union(docs)).where("kept").count() == 2 * len(good)
    found = estimate(votes(text_counts(docs)))
    assert abs(sum(found.shares) - 1) < 1e-9 and found.shares[0] > 0.7


def test_rules_on_an_empty_table(spark):
    assert weak_quality(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def _plain_trie(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()[:16]
            own[conv].append(((turn is not None, turn), digest, (role, text)))
    own = {c: [t for _, _, t in sorted(turns)] for c, turns in own.items()}
    nodes = defaultdict(list)
    lengths = {}
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        path = tuple(own.get(c - int(math.fmod(c, 20)), [])[:h] + mine[h:])
        lengths[c] = len(path)
        for d in range(len(path) + 1):
            nodes[path[:d]].append(c)
    children = defaultdict(list)
    for path in nodes:
        if path:
            children[path[:-1]].append(path)
    below = {}
    for path in sorted(nodes, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", path[-1][1])) if path else 0
        leaves = sum(below[x][0] for x in children[path]) or 1
        below[path] = leaves, (len(nodes[path]) - 1) * words + sum(below[x][1] for x in children[path])
    for path, convs in nodes.items():
        ends = ",".join(str(c) for c in sorted(convs) if lengths[c] == len(path))
        yield (min(convs), len(path), min(nodes[path[:-1]]) if path else None, len(convs), len(children[path]), *below[path],
               hashlib.sha256(ends.encode()).hexdigest())


def _conversations():
    draw = random.Random(9)
    rows = []
    for conv in [*range(0, 130), 205, 1000, -7, -40]:
        for turn in range(draw.randrange(0, 9)):
            rows.append((conv, turn, draw.choice(["user", "assistant", None]), draw.choice(["hello there", "yes", "", None, "no way out"])))
    rows += [(40, None, "user", "first"), (41, 0, "user", "tie"), (41, 0, "user", "tie"), (41, 0, "user", "other"), (None, 0, "user", "nobody")]
    for conv in (300, 301, 320, 321, 322):     # long, alike for long, of different lengths
        rows += [(conv, turn, "user", f"turn {turn}" if turn < 70 or conv != 321 else "apart") for turn in range(90 + conv % 7)]
    rows += [(conv, turn, "user", f"copy {turn}") for conv in range(400, 900) for turn in range(3)]
    draw.shuffle(rows)
    return rows


@pytest.mark.parametrize("block", [4096, 7, 1])
def test_trie_equals_the_plain_one(spark, block):
    rows = _conversations()
    turns = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, depth string, key int").repartition(5)
    got = sorted(map(tuple, prefix_trie(turns, block=block).collect()), key=repr)
    assert got == sorted(_plain_trie(rows), key=repr)


def test_trie_of_an_empty_table(spark):
    assert prefix_trie(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []
