"""Byte-level BPE encoding and decoding by forced-boundary splitting.

A pair of neighbouring bytes that occurs inside no token of the vocabulary can never be merged over: between
the two every encoding has a cut. Such pairs are read off the vocabulary once (65,536 bits). They are used
twice:

1. Text level. Where white space follows anything else the pre-tokenizer also always cuts, and what lies on
   either side does not depend on the other. At the forced pairs among these places the text falls into
   fragments, mostly a word with the white space before it, which are encoded independently and
   concatenated. Long texts are split piece by piece. Equal fragments of a task are encoded once, as long as
   they are in its bounded cache.
2. Fragment level. The pre-tokenizer's pattern gives the pieces of a fragment; beyond U+024F, where character
   classes differ between Unicode versions, it is the library's own. Long pieces are cut at their forced pairs,
   and the merges run on what lies between two cuts, lowest rank first, leftmost of equals. The many short pieces
   are merged together, those of one length as the rows of an array; a forced pair never has a rank there.

Special tokens in a text are found first and stand for themselves, as the library does unless told otherwise.
Decoding joins the bytes of the tokens; invalid UTF-8 becomes U+FFFD, as in the library.

Defined results: a null text is an empty one and has no tokens, null ids decode to an empty text. Every row
gives one row, also repeated ones; an empty table gives none. Only the columns named as keys are carried.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

# The characters with the Unicode property White_Space, of one and of several bytes.
_WHITE = "\t\n\x0b\x0c\r "
_WIDE_WHITE = "\u0085\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


@dataclass(frozen=True)
class Settings:
    piece: int = 1 << 20  # bytes of a long text that are split at once
    cached: int = 300_000  # pieces of the pre-tokenizer that a task remembers
    cached_fragments: int = 250_000  # and fragments
    cached_bytes: int = 64  # longer ones are not remembered
    rows: int = 1000  # rows of a batch that are held as Python objects
    block: int = 4 << 20  # bytes of text whose new pieces are merged together


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in vocabularies of this kind.

    Printable Latin-1 characters stand for themselves, the other bytes for the characters from U+0100 on.
    """
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {**{chr(b): b for b in plain}, **{chr(256 + i): b for i, b in enumerate(rest)}}


@dataclass(frozen=True)
class Vocabulary:
    """What a task needs; its size is that of the vocabulary file."""

    tokens: list  # bytes of each id, None for unused ids
    first: list  # id of each single byte
    ranks: dict  # (left id, right id) -> rank of the merge
    joined: list  # id that the merge of each rank makes
    specials: dict  # text -> id

    @property
    def forced(self) -> np.ndarray:
        """forced[256 * a + b]: the bytes a, b stand side by side in no token."""
        inside = np.zeros(1 << 16, bool)
        for token in self.tokens:
            if token is not None and len(token) > 1:
                raw = np.frombuffer(token, np.uint8).astype(np.int64)
                inside[(raw[:-1] << 8) | raw[1:]] = True
        return ~inside


def load(path: str) -> Vocabulary:
    """Read a vocabulary file of the tokenizers library. Other kinds than plain byte-level BPE are refused."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, before = spec["model"], spec.get("pre_tokenizer") or {}
    odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix") if model.get(k)]
    if model.get("type") != "BPE" or odd or model.get("byte_fallback") or model.get("ignore_merges"):
        raise ValueError("only plain byte-level BPE vocabularies")
    if spec.get("normalizer") or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True):
        raise ValueError("only byte-level pre-tokenizers without normalizer and prefix space")
    # Truncation and padding are settings of a caller, not of the vocabulary: they are not applied.
    specials = {}
    for added in spec.get("added_tokens", []):
        if added.get("lstrip") or added.get("rstrip") or added.get("single_word"):
            raise ValueError("added tokens must match as they stand")
        specials[added["content"]] = added["id"]
    of = byte_alphabet()
    ids = model["vocab"]
    tokens: list = [None] * (1 + max([*ids.values(), *specials.values()]))
    for text, i in ids.items():
        tokens[i] = bytes(of[c] for c in text)
    for text, i in specials.items():
        tokens[i] = text.encode()
    pairs = [pair.split(" ") if isinstance(pair, str) else pair for pair in model["merges"]]
    ranks = {(ids[left], ids[right]): rank for rank, (left, right) in enumerate(pairs)}
    char = {b: c for c, b in of.items()}
    return Vocabulary(tokens, [ids[char[b]] for b in range(256)], ranks, [ids[left + right] for left, right in pairs], specials)


_NEVER = np.int32(2**31 - 1)  # rank of a pair without a merge
_SHORT = 32  # bytes of a piece that is merged together with others


class Merger:
    """Applies the merges, lowest rank first, leftmost of equals."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.first = np.array(vocabulary.first, np.int32)
        self.joined = np.array([*vocabulary.joined, 0], np.int32)
        # Pairs and their ranks in a table with open addressing, a quarter full at most.
        self.bits = max(8, (4 * len(vocabulary.ranks)).bit_length())
        self.keys, self.ranks = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, _NEVER, np.int32)
        pairs = np.array(list(vocabulary.ranks), np.int64).reshape(-1, 2)
        keys, ranks = pairs[:, 0] << 32 | pairs[:, 1], np.array(list(vocabulary.ranks.values()), np.int32)
        at = self._home(keys)
        while len(keys):
            _, one = np.unique(at, return_index=True)  # of several pairs for a free place, one takes it
            one = one[self.keys[at[one]] < 0]
            self.keys[at[one]], self.ranks[at[one]] = keys[one], ranks[one]
            left = np.ones(len(keys), bool)
            left[one] = False
            keys, ranks, at = keys[left], ranks[left], (at[left] + 1) & ((1 << self.bits) - 1)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, _NEVER where there is none or a side is missing."""
        keys = left.astype(np.int64) << 32 | right
        at = self._home(keys)
        out = self.ranks[at]
        open_ = np.flatnonzero((self.keys[at] != keys) & (self.keys[at] >= 0))
        out[self.keys[at] != keys] = _NEVER
        at = at[open_]
        while len(open_):
            at = (at + 1) & ((1 << self.bits) - 1)
            there = self.keys[at]
            hit = there == keys[open_]
            out[open_[hit]] = self.ranks[at[hit]]
            on = ~hit & (there >= 0)
            open_, at = open_[on], at[on]
        return out

    def together(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of pieces of one length, all merged at once, as little-endian 32-bit integers."""
        size, n = len(pieces[0]), len(pieces)
        ids = self.first[np.frombuffer(b"".join(pieces), np.uint8).reshape(n, size)]
        lengths = np.full(n, size)
        if size > 1:
            ranks = self.rank(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(n, size - 1)
            live = np.arange(n)
            own, now = ids.copy(), ranks
            while True:
                at = now.argmin(axis=1)
                best = now[np.arange(len(live)), at]
                on = best != _NEVER
                if not on.all():
                    ids[live[~on]] = own[~on]
                    live, own, now, at, best = live[on], own[on], now[on], at[on], best[on]
                if not len(live):
                    break
                rows = np.arange(len(live))
                lengths[live] -= 1
                # The places behind the pair move one to the left; the last ones are empty then.
                own[rows, at] = self.joined[best]
                behind = np.arange(size)[None, :] > at[:, None]
                own[:, :-1] = np.where(behind[:, :-1], own[:, 1:], own[:, :-1])
                own[:, -1] = -1
                now[:, :-1] = np.where(behind[:, : size - 2] | (np.arange(size - 2)[None, :] == at[:, None]), now[:, 1:], now[:, :-1])
                now[:, -1] = _NEVER
                last = at + 1 < lengths[live]
                now[rows[last], at[last]] = self.rank(own[rows[last], at[last]], own[rows[last], at[last] + 1])
                first = at > 0
                now[rows[first], at[first] - 1] = self.rank(own[rows[first], at[first] - 1], own[rows[first], at[first]])
        raw = ids.astype("<u4").tobytes()
        return [raw[4 * size * i : 4 * (size * i + k)] for i, k in enumerate(lengths.tolist())]

    def alone(self, ids: list[int]) -> list[int]:
        """The same for one fragment of any length, in n log n steps: a heap of the pairs, and links between what is
        left of the places."""
        n, joined, rank_of = len(ids), self.vocabulary.joined, self.vocabulary.ranks.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        ids = list(ids)
        heap = [(rank, i) for i, rank in enumerate(map(rank_of, zip(ids, ids[1:]))) if rank is not None]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            if ids[i] < 0 or after[i] >= n or rank_of((ids[i], ids[after[i]])) != rank:  # merged or changed since
                continue
            right = after[i]
            ids[i], ids[right] = joined[rank], -1
            after[i] = after[right]
            for left, other in ((i, after[i]), (before[i], i)):
                if left >= 0 and other < n:
                    before[other] = left
                    rank = rank_of((ids[left], ids[other]))
                    if rank is not None:
                        heapq.heappush(heap, (rank, left))
        return [i for i in ids if i >= 0]


def _simple_pattern() -> re.Pattern:
    """The pre-tokenizer's pattern for characters below U+0250, whose classes are the same in every Unicode version."""
    kinds = {"L": "", "N": ""}
    for c in map(chr, range(0x250)):
        kind = unicodedata.category(c)[0]
        if kind in kinds:
            kinds[kind] += re.escape(c)
    letters, digits = kinds["L"], kinds["N"]
    white = _WHITE + "\u0085\u00a0"
    return re.compile(
        f"'s|'t|'re|'ve|'m|'ll|'d| ?[{letters}]+| ?[{digits}]+| ?[^{white}{letters}{digits}]+|[{white}]+(?![^{white}])|[{white}]+"
    )


class Encoder:
    """Encodes texts with a vocabulary; one per task."""

    def __init__(self, vocabulary: Vocabulary, settings: Settings = Settings()):
        from tokenizers.pre_tokenizers import ByteLevel

        self.vocabulary, self.settings, self.merger = vocabulary, settings, Merger(vocabulary)
        self.forced = vocabulary.forced
        self.simple = _simple_pattern().findall
        self.library = ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str
        self.fragments: dict[bytes, bytes] = {}  # ids as little-endian 32-bit integers
        self.pieces: dict[str, bytes] = {}
        self.long: list[str] = []  # pieces that are forgotten again
        self.specials = {text.encode(): np.array([i], "<u4").tobytes() for text, i in vocabulary.specials.items()}
        longest = sorted(self.specials, key=len, reverse=True)
        self.special = re.compile(b"(" + b"|".join(map(re.escape, longest)) + b")") if longest else None
        # Forced pairs of anything and white space: cuts that the pre-tokenizer makes as well.
        white = np.zeros(256, bool)
        white[[ord(w) for w in _WHITE]] = True
        self.cutting = self.forced & np.repeat(~white, 256) & np.tile(white, 256)
        self.wide = {w.encode() for w in _WIDE_WHITE}

    def _split(self, text: bytes) -> Iterator[list[bytes]]:
        """The fragments of a text, in lists of bounded length: cut where a forced pair begins white space."""
        begin, n = 0, len(text)
        for at in range(0, n, self.settings.piece):
            raw = np.frombuffer(text, np.uint8, min(self.settings.piece + 1, n - at), at).astype(np.uint16)
            cuts = np.flatnonzero(self.cutting[(raw[:-1] << 8) | raw[1:]]) + (at + 1)
            # White space of several bytes before the cut goes on there: no cut of the pre-tokenizer.
            wide = self.wide
            places = [c for c in cuts.tolist() if text[c - 1] < 128 or not (text[c - 2 : c] in wide or text[c - 3 : c] in wide)]
            if places:
                yield [text[a:b] for a, b in zip([begin, *places], places)]
                begin = places[-1]
        if begin < n:
            yield [text[begin:]]

    def _pieces_of(self, fragment: bytes) -> list[str]:
        text = fragment.decode()
        if max(text) < "\u0250":
            return self.simple(text)
        return [text[a:b] for _, (a, b) in self.library(text)]

    def _encode_long(self, piece: bytes) -> bytes:
        """Cut at the forced pairs, merge between them."""
        raw = np.frombuffer(piece, np.uint8).astype(np.int64)
        cuts = (np.flatnonzero(self.forced[(raw[:-1] << 8) | raw[1:]]) + 1).tolist()
        first, ids = self.vocabulary.first, []
        for a, b in zip([0, *cuts], [*cuts, len(piece)]):
            ids += self.merger.alone([first[c] for c in piece[a:b]])
        return np.array(ids, "<u4").tobytes()

    def _learn(self, found: set[bytes]) -> None:
        """Encode fragments that are not known: their pieces by length, those of a length together."""
        cut = {f: self._pieces_of(f) for f in found}
        new = {p for pieces in cut.values() for p in pieces} - self.pieces.keys()
        by_length: dict[int, list[tuple[str, bytes]]] = {}
        for p in new:
            raw = p.encode()
            by_length.setdefault(len(raw), []).append((p, raw))
        for length, some in by_length.items():
            if length > _SHORT:
                self.long += [p for p, _ in some if len(p) > self.settings.cached_bytes]
                self.pieces.update((p, self._encode_long(raw)) for p, raw in some)
            else:
                self.pieces.update(zip([p for p, _ in some], self.merger.together([raw for _, raw in some])))
        known = self.pieces
        for f, pieces in cut.items():
            self.fragments[f] = b"".join([known[p] for p in pieces])

    def _forget(self, found: set[bytes]) -> None:
        """Keep the caches within their bounds; long fragments and pieces are not kept."""
        for cache, most in ((self.fragments, self.settings.cached_fragments), (self.pieces, self.settings.cached)):
            if len(cache) > most:
                cache.clear()
        for f in found:
            if len(f) > self.settings.cached_bytes:
                self.fragments.pop(f, None)
        for p in self.long:
            self.pieces.pop(p, None)
        self.long.clear()

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        out: list[list[bytes]] = [[] for _ in texts]
        held: list[tuple[int, list[bytes]]] = []
        size = 0

        def settle():
            nonlocal size
            new = {f for _, fragments in held for f in fragments} - self.fragments.keys()
            if new:
                self._learn(new)
            known = self.fragments
            for i, fragments in held:
                out[i].append(b"".join([known[f] for f in fragments]))
            held.clear()
            size = 0
            if new:
                self._forget(new)

        for i, text in enumerate(texts):
            raw = text.encode()
            for part in self.special.split(raw) if self.special else [raw]:
                if part in self.specials:
                    settle()
                    out[i].append(self.specials[part])
                    continue
                for fragments in self._split(part):
                    held.append((i, fragments))
                    size += sum(map(len, fragments))
                    if size >= self.settings.block:
                        settle()
        settle()
        return [b"".join(parts) for parts in out]

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]


def decode_ids(ids: bytes, tokens: list) -> str:
    """The text of the ids; unknown ids stand for nothing."""
    raw = np.frombuffer(ids, "<u4")
    known = len(tokens)
    return b"".join([tokens[i] or b"" for i in raw.tolist() if i < known]).decode("utf-8", "replace")


def _per_row(df: DataFrame, keys: list[str], value: str, work, out: dict[str, T.DataType], step: int) -> DataFrame:
    """keys and the columns of out, made by work()(values) for some rows at a time; work makes the function inside the
    task."""
    rows = df.select(F.struct(*[F.col(k) for k in keys]).alias("row"), F.col(value).alias("value"))
    kinds = [pa.binary() if isinstance(kind, T.BinaryType) else pa.string() for kind in out.values()]
    names = [f"out{i}" for i in range(len(out))]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        change = work()
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                columns = change(part["value"].to_pylist())
                yield pa.RecordBatch.from_arrays([part["row"], *map(pa.array, columns, kinds)], names=["row", *names])

    schema = T.StructType([rows.schema["row"], *[T.StructField(n, kind) for n, kind in zip(names, out.values())]])
    made = rows.mapInArrow(task, schema)
    return made.select("row.*", *[F.col(n).alias(name) for n, name in zip(names, out)])


def share(spark: SparkSession, vocabulary: Vocabulary):
    """The vocabulary for all tasks: one broadcast of the size of its file."""
    return spark.sparkContext.broadcast(vocabulary)


def encode(docs: DataFrame, shared, keys: list[str], text: str = "text", settings: Settings = Settings(), decoded: bool = False) -> DataFrame:
    """keys and ids: the token ids of each text, as little-endian unsigned 32-bit integers.

    With `decoded`, also what these ids stand for, decoded in the same task to check the round trip.
    """
    def work():
        encoder, tokens = Encoder(shared.value, settings), shared.value.tokens

        def change(values):
            ids = encoder.encode_all([v or "" for v in values])
            return [ids, [decode_ids(i, tokens) for i in ids]] if decoded else [ids]

        return change

    out = {"ids": T.BinaryType(), "decoded": T.StringType()} if decoded else {"ids": T.BinaryType()}
    return _per_row(docs, keys, text, work, out, settings.rows)


def decode(encoded: DataFrame, shared, keys: list[str], ids: str = "ids", settings: Settings = Settings()) -> DataFrame:
    """keys and text: what the ids of each row stand for."""
    def work():
        tokens = shared.value.tokens
        return lambda values: [[decode_ids(v or b"", tokens) for v in values]]

    return _per_row(encoded, keys, ids, work, {"text": T.StringType()}, settings.rows)
