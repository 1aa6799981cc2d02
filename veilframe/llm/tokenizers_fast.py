"""Exact token ids and counts of the two public JSON vocabularies, faster than the library's whole pipeline.

Text is cut where a token can never span (between a printable character and the white space after it), the cuts are
looked up in a bounded memory, and only unseen ones are split into pre-tokens and merged, by the library's own model.

What Python's character classes and the library's could see differently is settled offline, once for a process: every
code point below 2**16 is tried in several surroundings, and those with any difference are listed. A text with such a
code point, with one above, or with the string of a special token is given to the library as a whole.

Ids of whole columns (``IdWriter.of_column``) take the same cuts, but Arrow splits the texts and finds the distinct
stretches, the merges of all unseen pre-tokens run side by side in numpy (``Merges``), and the ids are put together by
one gather.
"""

from __future__ import annotations

import ctypes
import json
import re
import struct
import sys
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import compress
from operator import not_
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

SLICE = 1 << 20         # characters handled at a time
MEMORY = 32 << 20       # bytes that one memory of an encoder may take, in each of two generations
STRETCH = 8 << 20       # bytes of texts whose distinct stretches are looked up together
GATHER = 1 << 18        # stretches whose ids are put together at a time

# The splitting rules of the two vocabularies, in the terms of Python's re.
BYTE_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
WORD_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+")
# The same over stretches that are joined by a NUL, which is a piece of its own and where a text may end.
_BYTE_JOINED = re.compile(r"\x00|'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w\x00]|_)+|\s+(?![^\s\x00])|\s+")
_WORD_JOINED = re.compile(r"\x00|'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w\x00]|_)+")
# Byte-level vocabularies write a byte as itself if it is printable, else as a character above 255.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_CHARS = {b: chr(b) for b in _PRINTABLE} | {
    b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in set(_PRINTABLE))}
_TO_CHARS = {b: c for b, c in BYTE_CHARS.items()}

# Last bytes, in UTF-8, of the characters of white space.
_SPACE_ENDS = np.zeros(256, bool)
_SPACE_ENDS[[chr(k).encode()[-1] for k in range(1 << 16) if chr(k).isspace()]] = True

_CUT = re.compile(r"(?<=\S)(?=\s)")
_RUNS = re.compile(r"(\s\s+)")


class Plan(NamedTuple):
    """What was settled offline about a vocabulary."""
    path: str
    kind: str                   # "byte", "word", or "other": always the library
    unsafe: str                 # pattern of what is left to the library
    whole: frozenset            # pre-tokens proven to be one token


@lru_cache(maxsize=8)
def tokenizer(path: str) -> Tokenizer:
    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


def _kind(spec: dict) -> str:
    pre = spec.get("pre_tokenizer") or {}
    if spec["model"].get("type") != "BPE" or spec["model"].get("dropout"):
        return "other"
    if pre.get("type") == "ByteLevel" and pre["use_regex"] and not pre["add_prefix_space"] and not spec.get("normalizer"):
        return "byte"
    steps = [x["type"] for x in (spec.get("normalizer") or {}).get("normalizers", [])]
    if pre.get("type") == "Sequence" and [x["type"] for x in pre["pretokenizers"]] == ["Split", "ByteLevel"] \
            and steps == ["NFC", "Replace", "Lowercase"] and spec["model"].get("end_of_word_suffix") == "</w>":
        return "word"
    return "other"


def in_bytes(piece: str) -> str:
    if piece.isascii() and piece.isprintable():     # only the space is written otherwise
        return piece.replace(" ", BYTE_CHARS[32])
    return piece.encode("utf-8", "surrogatepass").decode("latin-1").translate(_TO_CHARS)


def _library_pieces(tok: Tokenizer, text: str) -> list[str]:
    text = tok.normalizer.normalize_str(text) if tok.normalizer else text
    return [piece for piece, _ in tok.pre_tokenizer.pre_tokenize_str(text)]


def _own_pieces(kind: str, text: str) -> list[str]:
    if kind == "byte":
        return [in_bytes(x) for x in BYTE_PIECES.findall(text)]
    return [in_bytes(x) for chunk in text.split() for x in WORD_PIECES.findall(chunk.lower())]


def _differing(tok: Tokenizer, kind: str) -> list[int]:
    """Code points below 2**16 that could be handled differently."""
    found = []
    for point in range(1 << 16):
        c = chr(point)
        if 0xD800 <= point < 0xE000 or unicodedata.combining(c) or unicodedata.normalize("NFC", c) != c \
                or unicodedata.category(c)[0] == "M" or 0x1100 <= point < 0x1200:
            found.append(point)
            continue
        trial = f"a{c}a{c} {c}a1{c}1 {c}!{c}! {c}{c} {c}"
        if _own_pieces(kind, trial) != _library_pieces(tok, trial):
            found.append(point)
    return found


def _ranges(points: list[int]) -> str:
    out, k = [], 0
    while k < len(points):
        end = k
        while end + 1 < len(points) and points[end + 1] == points[end] + 1:
            end += 1
        out.append(f"\\u{points[k]:04x}-\\u{points[end]:04x}")
        k = end + 1
    return "".join(out)


@lru_cache(maxsize=8)
def plan(path: str) -> Plan:
    """Study a vocabulary: what Python splits alike, and which strings are proven to be one token."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    tok, kind = tokenizer(path), _kind(spec)
    if kind == "other":
        return Plan(path, kind, "", frozenset())
    special = "|".join(re.escape(x["content"]) for x in spec["added_tokens"])
    unsafe = f"[{_ranges(_differing(tok, kind))}\\U00010000-\\U0010ffff]" + (f"|{special}" if special else "")
    return Plan(path, kind, unsafe, _whole_tokens(tok, kind, spec))


def _whole_tokens(tok: Tokenizer, kind: str, spec: dict) -> frozenset:
    """Vocabulary strings that are one pre-token and that the merges bring to exactly that one token."""
    back = {c: b for b, c in BYTE_CHARS.items()}
    proven, suffix = set(), spec["model"].get("end_of_word_suffix") or ""
    for string, number in spec["model"]["vocab"].items():
        if not string.endswith(suffix):
            continue
        mapped = string[:len(string) - len(suffix)] if suffix else string
        try:
            text = bytes(back[c] for c in mapped).decode("utf-8")
        except (KeyError, UnicodeDecodeError):
            continue
        if text and _library_pieces(tok, text) == [mapped] and [t.id for t in tok.model.tokenize(mapped)] == [number]:
            proven.add(text)
    return frozenset(proven)


class Memory(dict):
    """Memory of ``compute``, bounded by bytes: two generations, so what is in use stays."""

    ENTRY = 110     # of a dictionary, for a key and a value

    def __init__(self, compute: Callable, limit: int = MEMORY) -> None:
        super().__init__()
        self.compute, self.limit, self.size, self.old = compute, limit, 0, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
        if len(key) < 256:  # a giant key is not worth keeping
            if self.size >= self.limit:
                self.old, self.size = dict(self), 0
                self.clear()
            self.size += sys.getsizeof(key) + sys.getsizeof(value) + self.ENTRY
            self[key] = value
        return value

    def forget(self) -> None:
        self.clear()
        self.old, self.size = {}, 0


def _slices(text: str) -> Iterator[str]:
    start = 0
    while len(text) - start > SLICE:
        cut = _CUT.search(text, start + SLICE)
        if not cut:
            break
        yield text[start:cut.start()]
        start = cut.start()
    yield text[start:] if start else text


class _Encoder:
    """Walks over texts; subclasses say what a pre-token gives, what parts give together, and what the library says."""

    def __init__(self, settled: Plan) -> None:
        self.plan, self.tok = settled, tokenizer(settled.path)
        self.model = self.tok.model
        self.unsafe = re.compile(settled.unsafe) if settled.kind != "other" else None
        self.pieces = Memory(self.of_piece, MEMORY // 4)
        # a stretch of text as it stands: all of them for words, else only those with no space before
        self.plain = Memory(self._of_chunk, MEMORY if settled.kind == "word" else MEMORY // 4)
        self.spaced = Memory(lambda chunk: self._of_chunk(" " + chunk))  # the same with a space before it

    def _of_chunk(self, chunk: str):
        pieces = BYTE_PIECES.findall(chunk) if self.plan.kind == "byte" else WORD_PIECES.findall(chunk.lower())
        if len(pieces) == 1:
            return self.of_piece(pieces[0])
        return self.join(map(self.pieces.__getitem__, pieces))

    def of_text(self, text: str):
        if self.plan.kind == "other" or self.unsafe.search(text):
            return self.of_library(text)
        return self.join(map(self._word_slice if self.plan.kind == "word" else self._byte_slice, _slices(text)))

    def _word_slice(self, text: str):
        return self.join(map(self.plain.__getitem__, text.split()))

    def _byte_slice(self, text: str):
        """White space stands alone between chunks, but for runs of it: their last one belongs to what follows."""
        found, spaced = [], False
        parts = _RUNS.split(text)
        for k, part in enumerate(parts):
            if k % 2:
                if k == len(parts) - 2 and not parts[-1]:
                    found.append(self.plain[part])
                    continue
                found.append(self.plain[part[:-1]])
                spaced = part[-1] == " "
                if not spaced:
                    found.append(self.plain[part[-1]])
            elif part:
                first, *rest = part.split(" ")
                found.append(self.spaced[first] if spaced else self.plain[first])
                found.extend(map(self.spaced.__getitem__, rest))
                spaced = False
        return self.join(found)


class Merges:
    """The merges of a byte-level vocabulary, made for many pre-tokens at once.

    Every round merges the pair of least rank, the first of equal ones, in each pre-token that has any: what the
    library's model does for one at a time. ``make`` gives None for a model with rules beyond that.
    """

    LONGEST = 32                # bytes; longer pre-tokens are left to the library
    STEPS = (4, 6, 8, 11, 15, 21, 32)   # pre-tokens of like lengths are handled together

    def __init__(self, first: np.ndarray, last: np.ndarray, pairs: np.ndarray, made: np.ndarray) -> None:
        self.first, self.last = first, last     # ids of a byte, and of a byte at the end
        self.none = len(pairs)                  # rank of what is no pair
        self.made = np.append(made, 0).astype(np.int32)
        self.bits = max(10, (4 * len(pairs)).bit_length())
        self.keys, self.ranks = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, self.none, np.int32)
        left, place = np.arange(len(pairs)), self._places(pairs)
        while len(left):    # an occupied place is passed over
            free = self.keys[place] < 0
            _, chosen = np.unique(np.where(free, place, -1), return_index=True)
            chosen = chosen[free[chosen]]
            self.keys[place[chosen]], self.ranks[place[chosen]] = pairs[left[chosen]], left[chosen]
            stays = np.ones(len(left), bool)
            stays[chosen] = False
            left, place = left[stays], place[stays]
            place = np.where(self.keys[place] >= 0, (place + 1) & ((1 << self.bits) - 1), place)

    @classmethod
    def make(cls, path: str, kind: str) -> Merges | None:
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        if kind == "other" or any(model.get(x) for x in ("ignore_merges", "byte_fallback", "continuing_subword_prefix", "dropout")):
            return None
        try:
            first, last = (np.array([vocab[BYTE_CHARS[b] + end] for b in range(256)], np.int32) for end in ("", suffix))
            merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
            pairs = np.array([vocab[a] << 32 | vocab[b] for a, b in merges], np.int64).reshape(-1)
            made = np.array([vocab[a + b] for a, b in merges], np.int32)
        except (KeyError, ValueError):
            return None
        return cls(first, last, pairs, made) if len(np.unique(pairs)) == len(pairs) else None

    def _places(self, pairs: np.ndarray) -> np.ndarray:
        return ((pairs >> 32) * 0x9E3779B1 + (pairs & 0xFFFFFFFF) * 0x85EBCA77 >> 9) & ((1 << self.bits) - 1)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair; an id of -1 is in none."""
        pairs = a.astype(np.int64) << 32 | b.astype(np.int64) & 0xFFFFFFFF
        place = self._places(pairs)
        held = self.keys[place]
        found = np.where(held == pairs, self.ranks[place], self.none)
        left = np.flatnonzero((held != pairs) & (held >= 0))
        while len(left):
            place[left] = (place[left] + 1) & ((1 << self.bits) - 1)
            held = self.keys[place[left]]
            hit = held == pairs[left]
            found[left[hit]] = self.ranks[place[left[hit]]]
            left = left[~hit & (held >= 0)]
        return found

    def ids(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pre-tokens of 1 to ``LONGEST`` bytes, one after the other, and how many each has."""
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        return self.of_bytes(np.frombuffer(b"".join(pieces), np.uint8), np.cumsum(sizes) - sizes, sizes)

    def of_bytes(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for pre-tokens that stand in ``data``."""
        grid, counts = np.full((len(sizes), self.LONGEST), -1, np.int32), sizes.copy()
        shorter = 0
        for longest in self.STEPS:
            rows = np.flatnonzero((sizes > shorter) & (sizes <= longest))
            shorter = longest
            if len(rows):
                self._merge(rows, longest, data, starts[rows], sizes[rows], grid, counts)
        return grid[np.arange(self.LONGEST) < counts[:, None]].astype(np.uint32), counts

    def _merge(self, rows, longest, data, starts, sizes, grid, counts) -> None:
        ids = np.full((longest + 1, len(rows)), -1, np.int32)     # by place, then by pre-token
        for k in range(longest):
            has = sizes > k
            ids[k, has] = self.first[data[starts[has] + k]]
        ids[sizes - 1, np.arange(len(rows))] = self.last[data[starts + sizes - 1]]
        ranks = np.stack([self.rank(ids[k], ids[k + 1]) for k in range(longest)])
        while True:
            best = ranks.min(0)
            on = best < self.none
            if not on.all():
                done = ~on
                grid[rows[done], :len(ids) - 1] = ids[:-1, done].T
                counts[rows[done]] = (ids[:, done] >= 0).sum(0)
                if not on.any():
                    return
                rows, best, ids, ranks = rows[on], best[on], ids[:, on], ranks[:, on]
            column = np.arange(len(rows))
            # the first: from it on, the least rank has been met
            at = len(ranks) - np.logical_or.accumulate(ranks == best, 0).sum(0, dtype=np.int8).astype(np.int64)
            for k in range(1, len(ids) - 1):    # what comes after moves up by one place
                after = at < k
                np.copyto(ids[k], ids[k + 1], where=after)
                np.copyto(ranks[k], ranks[k + 1] if k + 1 < len(ranks) else self.none, where=after)
            ids, ranks = ids[:-1], ranks[:-1]   # each has lost one id
            ids = np.concatenate((ids, np.full((1, len(rows)), -1, np.int32))) if len(ids) < 2 else ids
            made = self.made[best]
            ids[at, column] = made
            if not len(ranks):
                ranks = np.full((1, len(rows)), self.none, np.int32)
                continue
            inner = at < len(ranks)
            ranks[at[inner], column[inner]] = self.rank(made[inner], ids[at[inner] + 1, column[inner]])
            inner = at > 0
            ranks[at[inner] - 1, column[inner]] = self.rank(ids[at[inner] - 1, column[inner]], made[inner])


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of stretches, put together."""
    ends = np.cumsum(sizes)
    found = np.repeat(starts - (ends - sizes), sizes)
    found += np.arange(len(found))
    return found


def gathered(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray, order: np.ndarray | None = None) -> np.ndarray:
    """The values of stretches, put together; with ``order``, of the stretches that it numbers. Places are made for some at a time."""
    found = [values[:0]]
    for k in range(0, len(sizes) if order is None else len(order), GATHER):
        some = slice(k, k + GATHER) if order is None else order[k:k + GATHER]
        found.append(values[spread(starts[some], sizes[some])])
    return np.concatenate(found)


try:
    _trim = ctypes.CDLL(None).malloc_trim   # glibc has it
except (AttributeError, OSError, TypeError):
    _trim = None


def give_back() -> None:
    """Free memory that Arrow and the C library keep goes back to the system: a worker outlives the stage that needed it."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def _strings(texts: pa.Array) -> list[str]:
    return texts.to_numpy(zero_copy_only=False).tolist()


def _layout(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all strings, and where each begins and the last one ends."""
    ends = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, 4 * texts.offset) if len(texts) else np.zeros(1, np.int32)
    return np.frombuffer(texts.buffers()[2] or b"", np.uint8), ends


def _sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of consecutive stretches, of which some may be empty."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    ends = np.cumsum(sizes)
    return total[ends] - total[ends - sizes]


class Counter(_Encoder):
    """Number of tokens: 1 for a proven whole token; the rest is merged."""

    join = staticmethod(sum)

    def of_piece(self, piece: str) -> int:
        return 1 if piece in self.plan.whole else len(self.model.tokenize(in_bytes(piece)))

    def of_library(self, text: str) -> int:
        return len(self.tok.encode(text, add_special_tokens=False).ids)


class IdWriter(_Encoder):
    """Token ids as little-endian unsigned 32-bit integers."""

    join = staticmethod(b"".join)

    def __init__(self, settled: Plan) -> None:
        super().__init__(settled)
        self.merges = Merges.make(settled.path, settled.kind)
        # a special token with white space inside could lie across stretches
        self.by_column = self.merges is not None and not any(
            any(c.isspace() for c in x.content) for x in self.tok.get_added_tokens_decoder().values())
        self._forget()

    def _forget(self) -> None:
        """Pre-tokens that were merged, in the order of their numbers, and where their ids stand."""
        self.known = pa.array([], pa.string())
        self.starts, self.sizes, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)
        self.held = 0

    def forget(self) -> None:
        """Keep nothing of the texts so far, at the end of a task: its worker goes on to other stages."""
        self._forget()
        for memory in (self.pieces, self.plain, self.spaced):
            memory.forget()
        give_back()

    def of_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and how many each text has. Null texts have none."""
        found, counts = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for ids, sizes in self.of_stretches(texts):
            found.append(ids)
            counts.append(sizes)
        return np.concatenate(found), np.concatenate(counts)

    def of_stretches(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The same for some texts after the other, about ``STRETCH`` bytes at a time."""
        at = 0
        ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        while at < len(texts):
            upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + STRETCH, "right")))
            yield self._of_stretch(pc.fill_null(texts.slice(at, upto - at), ""))
            at = upto
        give_back()

    def _one_by_one(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        found = [self.of_text(text) if text else b"" for text in texts.to_pylist()]
        return np.frombuffer(b"".join(found), "<u4"), np.fromiter(map(len, found), np.int64, len(found)) // 4

    def _of_stretch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if not self.by_column or pc.sum(pc.binary_length(texts)).as_py() > 4 * STRETCH:
            return self._one_by_one(texts)
        parts = pc.split_pattern(texts, " ")
        per_text = pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
        first = np.cumsum(per_text) - per_text
        coded = parts.flatten().dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        values = coded.dictionary
        del parts
        slow = np.zeros(len(texts), bool)
        data, ends = _layout(values)
        joined = str(data[ends[0]:ends[-1]], "utf-8")
        if "\0" in joined or self.unsafe.search(joined):
            slow |= _sums(np.fromiter(("\0" in c or self.unsafe.search(c) is not None for c in _strings(values)), bool, len(values))[codes], per_text) > 0
        byte = self.plan.kind == "byte"
        # a chunk of letters is one word; what is not ASCII is asked of Python
        plain = pc.ascii_is_alpha(values).to_numpy(zero_copy_only=False)
        others = _strings(values.filter(pa.array(~plain)))
        if "\0" in joined:      # between the chunks that are split together
            others = [c.replace("\0", "") for c in others]
        values_plain = values.filter(pa.array(plain))
        if byte:
            # white space may go on after a stretch that is empty or ends with it, unless the text begins or ends there
            open_ = self._open(values)[codes]
            open_[first + per_text - 1] = False
            open_[first[codes[first] == pc.index(values, "").as_py()]] = False
            slow |= _sums(open_, per_text) > 0
            # what begins a text has no space before it: it gets numbers of its own
            begins, codes[first] = np.unique(codes[first], return_inverse=True)
            codes[first] += len(values)
            alpha = [c.isalpha() for c in others]
            words = pc.binary_join_element_wise(pa.scalar(" "), values_plain, pa.scalar(""))
            more = [" " + c for c in compress(others, alpha)]
            rest = [*(" " + c for c in compress(others, map(not_, alpha))),
                    *(c.replace("\0", "") for c in _strings(values.take(pa.array(begins))))]
        else:
            begins, lower = (), [c.lower() for c in others]
            alpha = [x.isalpha() for x in lower]     # small letters may hold marks
            words = pc.ascii_lower(values_plain)
            more = list(compress(lower, alpha))
            rest = [" ".join([x.lower() for x in c.split()]) for c in compress(others, map(not_, alpha))]
        found = (_BYTE_JOINED if byte else _WORD_JOINED).findall("\0".join(rest) + "\0") if rest else []
        marks = np.flatnonzero(np.fromiter(map("\0".__eq__, found), bool, len(found)))
        many = np.diff(marks, prepend=-1) - 1
        pieces = pa.array([*more, *filter("\0".__ne__, found)], pa.string())
        words_first, pieces = len(words) + len(more), pa.concat_arrays([words, pieces])
        joined = others = lower = words = more = rest = found = None    # not kept while new pre-tokens are merged
        numbers = self._numbers(pieces)
        # the chunks that are one word come first
        rank = np.ones(len(values) + len(begins), np.int8)
        rank[:len(values)][plain] = 0
        rank[np.flatnonzero(~plain)[~np.array(alpha, bool)]] = 2
        rank[len(values):] = 2
        places = np.empty(len(rank), np.int64)
        places[np.argsort(rank, kind="stable")] = np.arange(len(rank))
        codes = places[codes]
        many = np.concatenate((np.ones(words_first, np.int64), many))
        # of a chunk: its ids stand together
        ids = gathered(self.flat, self.starts[numbers], self.sizes[numbers])
        sizes = _sums(self.sizes[numbers], many)
        ends = np.cumsum(sizes)
        found, counts = gathered(ids, ends - sizes, sizes, codes), _sums(sizes[codes], per_text)
        if not slow.any():
            return found, counts
        cut = np.split(found, np.cumsum(counts)[:-1])
        for k in np.flatnonzero(slow).tolist():
            text = texts[k].as_py()
            cut[k] = np.frombuffer(self.of_text(text) if text else b"", "<u4")
            counts[k] = len(cut[k])
        return np.concatenate(cut), counts

    @staticmethod
    def _open(values: pa.Array) -> np.ndarray:
        """Which are empty or end with white space."""
        data, ends = _layout(values)
        found = ends[1:] == ends[:-1]
        if len(data):
            maybe = np.flatnonzero(~found & _SPACE_ENDS[data[np.maximum(ends[1:] - 1, 0)]])
            found[maybe] = [c[-1].isspace() for c in _strings(values.take(pa.array(maybe)))]
        return found

    def _numbers(self, pieces: pa.Array) -> np.ndarray:
        """Numbers of pre-tokens, after what was not known has been merged."""
        if self.held > MEMORY:
            self._forget()
        numbers = pc.fill_null(pc.index_in(pieces, value_set=self.known), -1).to_numpy().astype(np.int64)
        missing = np.flatnonzero(numbers < 0)
        if len(missing):
            coded = pieces.take(pa.array(missing)).dictionary_encode()
            data, ends = _layout(coded.dictionary)
            lengths = np.diff(ends).astype(np.int64)
            short = lengths <= Merges.LONGEST
            ids, sizes = self.merges.of_bytes(data, ends[:-1][short].astype(np.int64), lengths[short])
            rest = [self.of_piece(x) for x in _strings(coded.dictionary.filter(pa.array(~short)))]
            sizes = np.concatenate((sizes, np.fromiter((len(x) // 4 for x in rest), np.int64, len(rest))))
            starts = np.cumsum(sizes) - sizes + len(self.flat)
            # the short ones were merged first
            order = np.concatenate((np.flatnonzero(short), np.flatnonzero(~short)))
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            numbers[missing] = len(self.known) + place[coded.indices.to_numpy()]
            self.flat = np.concatenate((self.flat, ids, np.frombuffer(b"".join(rest), "<u4")))
            self.starts, self.sizes = np.concatenate((self.starts, starts)), np.concatenate((self.sizes, sizes))
            self.known = pa.concat_arrays([self.known, coded.dictionary.take(pa.array(order))])
            self.held = self.known.nbytes + self.starts.nbytes + self.sizes.nbytes + self.flat.nbytes
        return numbers

    def of_piece(self, piece: str) -> bytes:
        ids = [t.id for t in self.model.tokenize(in_bytes(piece))]
        return struct.pack(f"<{len(ids)}I", *ids)

    def of_library(self, text: str) -> bytes:
        ids = self.tok.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)


class PlainIdWriter(IdWriter):
    """As ``IdWriter``, but the strings of special tokens are ordinary text."""

    def __init__(self, settled: Plan) -> None:
        super().__init__(settled)
        self.tok = Tokenizer.from_file(settled.path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.tok.encode_special_tokens = True
        self.model = self.tok.model


_shared: dict[type, _Encoder] = {}


def shared_encoder(kind: type[_Encoder], settled: Plan) -> _Encoder:
    """The process's encoder of this kind: what it remembers serves all tasks of a Python worker, or until ``forget``.

    Any other is dropped: a worker outlives the stage that it was started for.
    """
    held = _shared.get(kind)
    if held is None or held.plan.path != settled.path:
        _shared.clear()
        _shared[kind] = held = kind(settled)
    return held
