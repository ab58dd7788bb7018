"""Removal of repeated byte strings, by blockwise suffix sorting with a difference cover.

A byte goes if some string of `length` bytes (200) that covers it starts in two places of the corpus. Strings
are judged on the input and never cross documents.

1. Every start of such a string (a suffix, compared on its first 200 bytes) belongs to the bucket of its
   anchor: the 32-byte gram with the smallest hash inside the string, the leftmost of equals. Equal strings
   have equal anchors, so a bucket holds all that can be equal. Neighbouring starts with one anchor form a
   segment. Segments are counted by hash, pre-aggregated in each task: a segment that occurs twice is
   repeated as a whole, a segment alone in its bucket is not, and the others are contested. One place stands
   for each contested segment, chosen in the count, so copies are never sent.
2. A second pass marks the repeated segments and sends the contested ones from their places. Buckets with
   contested segments are sorted one block at a time. Ranks of a difference cover sample, for
   prefixes of 160 bytes by doubling, are computed first. Suffixes that agree in their first 32 and last 40
   bytes are told apart by ternary partitioning, where two suffixes are compared by the ranks of the
   sample places at the same distance behind both; such a distance below 32 exists for any two. Memory is
   bounded by the block. A bucket above `bucket` segments is not sorted in one task: its strings are
   grouped by 128-bit hash over the cluster.
3. The ranges found are gathered per document and merged.

Bitmaps of fixed size tell the second pass which segments and places may matter; they let through too much
when full, never too little.

Defined results: null and empty texts have no bytes. Equal rows count as copies of each other, so texts of 200
bytes or more that occur twice vanish. Every row gives one row; an empty table gives none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from siftmark.llm.common import drop_table, materialise

_COVER = 32  # period of the difference cover
_HEAD, _MIDDLE = 32, 160
_PLACE = np.uint64((1 << 24) - 1)


@dataclass(frozen=True)
class Settings:
    length: int = 200
    gram: int = 32
    block: int = 1 << 20
    bucket: int = 20000
    bits: int = 26


def difference_cover(period: int) -> tuple[np.ndarray, np.ndarray]:
    """Residues such that every difference occurs between two of them, and the step for two residues.

    0..r-1 and the multiples of r cover all differences. step[i, j] is the least d with both i + d and j + d
    in the cover.
    """
    r = int(np.ceil(np.sqrt(period)))
    cover = np.zeros(period, bool)
    cover[:r] = True
    cover[::r] = True
    places = np.arange(period)
    inside = cover[(places[:, None] + places[None, :]) % period]
    return cover, np.argmax(inside[:, None, :] & inside[None, :, :], axis=2)


_IN_COVER, _STEP = difference_cover(_COVER)


def _grams(data: np.ndarray, size: int) -> np.ndarray:
    """A hash of the size (a power of two) bytes from each place on."""
    h = (data.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    step = 1
    while step < size:
        a, b = h[:-step], h[step:]
        h = (a ^ (a >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93) + (b ^ (b >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        step *= 2
    return h ^ (h >> np.uint64(31))


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of width values, from minima that run forwards and backwards in blocks."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def segments(pieces: list[bytes], settings: Settings) -> Iterator[tuple[int, int, int, int, bytes]]:
    """(piece, start, number of suffixes, anchor, bytes) of all segments; pieces are independent."""
    length = settings.length
    if (length - _MIDDLE) % 8 or length - _MIDDLE < _COVER:
        raise ValueError("length must be 192 or more, by steps of 8")
    long = [(i, p) for i, p in enumerate(pieces) if len(p) >= length]
    if not long:
        return
    data = np.frombuffer(b"".join(p for _, p in long), np.uint8)
    sizes = np.array([len(p) for _, p in long])
    begins = np.cumsum(sizes) - sizes
    hashes = _grams(data, settings.gram)
    # The upper bits of the hash, then the place: equal hashes go to the leftmost.
    keys = (hashes & ~_PLACE) | np.arange(len(hashes), dtype=np.uint64)
    anchors = (_sliding_min(keys, length - settings.gram + 1) & _PLACE).astype(np.int64)
    starts = np.arange(len(anchors))
    owner = np.repeat(np.arange(len(long)), sizes)[: len(anchors)]
    valid = starts + length <= (begins + sizes)[owner]
    first = valid & np.r_[True, (anchors[1:] != anchors[:-1]) | (owner[1:] != owner[:-1])]
    last = valid & np.r_[first[1:] | ~valid[1:], True]
    for a, b in zip(np.flatnonzero(first).tolist(), np.flatnonzero(last).tolist()):
        piece, text = long[owner[a]]
        at = a - int(begins[owner[a]])
        n = b - a + 1
        yield piece, at, n, int(hashes[anchors[a]].astype(np.int64)), text[at : at + n + length - 1]


def _pieces(batches: Iterator[pa.RecordBatch], settings: Settings):
    """Groups of (doc_id, th, offset in the document, bytes) of about a block; long texts in overlapping pieces."""
    group, size = [], 0
    for batch in batches:
        for doc, th, text in zip(batch["doc_id"].to_pylist(), batch["th"].to_pylist(), batch["text"].to_pylist()):
            raw = (text or "").encode()
            for at in range(0, max(len(raw) - settings.length + 1, 0), settings.block):
                piece = raw[at : at + settings.block + settings.length - 1]
                group.append((doc, th, at, piece))
                size += len(piece)
                if size >= settings.block:
                    yield group
                    group, size = [], 0
    if group:
        yield group


def _hash(raw: bytes) -> int:
    return xxhash.xxh3_64_intdigest(raw) - (1 << 63)


def _bit(bitmap: bytes, bits: int, key: int) -> int:
    at = key & ((1 << bits) - 1)
    return bitmap[at >> 3] >> (at & 7) & 1


def _base(doc, th: int) -> int:
    """A number for the document, from which its places count on."""
    return xxhash.xxh3_64_intdigest(f"{doc}:{th}")


def _place_of(base: int, at: int) -> int:
    """A signed number for a place of a document."""
    return ((base + at * 0x9E3779B97F4A7C15) & ((1 << 64) - 1)) - (1 << 63)


def _count_segments(settings: Settings):
    """(anchor, segment, place) of all segments."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _pieces(batches, settings):
            bases = [_base(doc, th) + offset * 0x9E3779B97F4A7C15 for doc, th, offset, _ in group]
            anchors, hashes, places = [], [], []
            for piece, at, _, anchor, raw in segments([p[3] for p in group], settings):
                anchors.append(anchor)
                hashes.append(_hash(raw))
                places.append(_place_of(bases[piece], at))
            columns = [pa.array(c, pa.int64()) for c in (anchors, hashes, places)]
            yield pa.RecordBatch.from_arrays(columns, names=["anchor", "segment", "place"])

    return run


def _pick_segments(shared, settings: Settings, doc_type: pa.DataType):
    """Rows of segments that may be repeated (raw is null), and of those that may stand for contested ones (raw holds
    their bytes)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        twice, contested = shared.value
        bits = settings.bits
        for group in _pieces(batches, settings):
            rows, seen = [], set()
            bases = [_base(doc, th) + offset * 0x9E3779B97F4A7C15 for doc, th, offset, _ in group]
            for piece, at, n, anchor, raw in segments([p[3] for p in group], settings):
                segment = _hash(raw)
                doc, th, offset, _ = group[piece]
                if _bit(twice, bits, anchor ^ segment):
                    rows.append((anchor, segment, doc, th, (offset + at) << 8 | n, None))
                if _bit(contested, bits, _place_of(bases[piece], at)) and (anchor, segment) not in seen:
                    seen.add((anchor, segment))
                    rows.append((anchor, segment, doc, th, (offset + at) << 8 | n, raw))
            columns = list(zip(*rows)) or [[]] * 6
            types = [pa.int64(), pa.int64(), doc_type, pa.int64(), pa.int64(), pa.binary()]
            names = ["anchor", "segment", "doc_id", "th", "at", "raw"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    return run


def _bitmap(rows: DataFrame, bits: int) -> bytes:
    """The bits of the keys in rows: each task fills the parts that are dealt to it."""
    size = 1 << 12

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, np.ndarray] = {}
        for batch in batches:
            at = batch["bit"].to_numpy()
            for part in np.unique(at >> 15):
                bit = at[(at >> 15) == part] & 32767
                np.bitwise_or.at(parts.setdefault(int(part), np.zeros(size, np.uint8)), bit >> 3, (1 << (bit & 7)).astype(np.uint8))
        yield pa.RecordBatch.from_pydict({"part": pa.array(list(parts), pa.int64()), "b": pa.array([p.tobytes() for p in parts.values()], pa.binary())})

    dealt = rows.select(F.expr(f"key & {(1 << bits) - 1}L").alias("bit")).repartition(F.shiftright("bit", 15))
    whole = bytearray(1 << (bits - 3))
    for r in dealt.mapInArrow(fill, "part long, b binary").toLocalIterator():
        whole[r.part * size : (r.part + 1) * size] = bytes(r.b)
    return bytes(whole)


def _dense(*keys: np.ndarray) -> np.ndarray:
    """Ranks of rows of keys, equal rows alike, first key first."""
    order = np.lexsort(keys[::-1])
    fresh = np.zeros(len(order), bool)
    for k in keys:
        s = k[order]
        fresh[1:] |= s[1:] != s[:-1]
    ranks = np.empty(len(order), np.int32)
    ranks[order] = np.cumsum(fresh)
    return ranks


def _sort_block(texts: list[bytes], length: int) -> list[np.ndarray]:
    """For each text, which of its suffixes has an equal one (on length bytes) elsewhere in the block."""
    data = np.frombuffer(b"".join(texts) + bytes(_COVER + 8), np.uint8)
    sizes = np.array([len(t) for t in texts])
    begins = np.cumsum(sizes) - sizes
    counts = sizes - length + 1
    total = int(sizes.sum())
    chunk = np.zeros(total + _COVER, np.uint64)
    for k in range(8):
        chunk = (chunk << np.uint64(8)) | data[k : k + len(chunk)]

    # Suffixes that agree in head and tail are one group at first. A hash of both tells most apart.
    chunks = lambda at, k: chunk[np.minimum(at + 8 * k, len(chunk) - 1)]
    suffix = np.repeat(begins, counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    tail = suffix + _MIDDLE
    found = np.zeros(len(suffix), bool)
    mixed = np.zeros(len(suffix), np.uint64)
    for place, words in ((suffix, 4), (tail, (length - _MIDDLE) // 8)):
        for k in range(words):
            mixed = (mixed ^ chunks(place, k)) * np.uint64(0xD6E8FEB86659FD93)
            mixed ^= mixed >> np.uint64(29)
    order = np.argsort(mixed)
    same = mixed[order][1:] == mixed[order][:-1]
    open_ = np.sort(order[np.r_[same, False] | np.r_[False, same]])
    if not len(open_):
        return np.split(found, np.cumsum(counts)[:-1])
    # Texts without such suffixes need no ranks: the others are a block of their own.
    has = np.unique(np.searchsorted(np.cumsum(counts), open_, "right"))
    if len(has) < 0.8 * len(texts):
        out = np.split(found, np.cumsum(counts)[:-1])
        for i, some in zip(has.tolist(), _sort_block([texts[i] for i in has.tolist()], length)):
            out[i] = some
        return out
    group = _dense(*(chunks(suffix[open_], k) for k in range(4)), *(chunks(tail[open_], k) for k in range((length - _MIDDLE) // 8)))

    # Ranks of the cover sample: 32 bytes, then doubled by ranks 32, 64 and 128 places on.
    limit = total
    sample = np.flatnonzero(_IN_COVER[np.arange(limit) % _COVER])
    rank32 = np.zeros(limit + _MIDDLE + 1, np.int32)
    rank32[sample] = 1 + _dense(*(chunks(sample, k) for k in range(4)))
    rank, done = rank32, _HEAD
    while done < 128:
        doubled = np.zeros_like(rank32)
        doubled[sample] = 1 + _dense(rank[sample], rank[np.minimum(sample + done, limit)])
        rank, done = doubled, 2 * done
    middle = np.zeros_like(rank32)
    middle[sample] = 1 + _dense(rank[sample], rank32[np.minimum(sample + 128, limit)])

    turn = 0
    while len(open_):
        sizes_of = np.bincount(group)
        many = sizes_of[group] > 1
        open_, group = open_[many], group[many]
        if not len(open_):
            break
        order = np.argsort(group, kind="stable")
        open_, group = open_[order], group[order]
        begin = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        size = np.diff(np.r_[begin, len(group)])
        pick = begin + (0x9E3779B1 * (turn + 1) + begin * 40503) % size
        pivot = np.repeat(suffix[open_[pick]], size)
        mine = suffix[open_]
        step = _STEP[pivot % _COVER, mine % _COVER]
        side = np.sign(middle[mine + step] - middle[pivot + step])
        label = np.repeat(np.arange(len(begin)), size)
        equal = side == 0
        alike = np.bincount(label[equal], minlength=len(begin))
        found[open_[equal & (alike[label] > 1)]] = True
        rest = ~equal
        group = np.unique(label[rest] * 2 + (side[rest] > 0), return_inverse=True)[1]
        open_ = open_[rest]
        turn += 1
    return np.split(found, np.cumsum(counts)[:-1])


def _ranges(at: int, found: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Byte ranges covered by the suffixes found of a segment."""
    edge = np.flatnonzero(np.diff(np.r_[False, found, False]))
    start = at >> 8
    return [(start + int(a), start + int(b) - 1 + length) for a, b in zip(edge[::2], edge[1::2])]


def _sorted_buckets(settings: Settings, doc_type: pa.DataType):
    """Rows come by anchor and segment; whole buckets are collected to blocks and sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: list[tuple] = []
        size, key = 0, None

        def solve() -> pa.RecordBatch:
            rows = []
            for (doc, th, at, _), found in zip(block, _sort_block([b[3] for b in block], settings.length)):
                rows += [(doc, th, a, b) for a, b in _ranges(at, found, settings.length)]
            columns = list(zip(*rows)) or [[]] * 4
            types = [doc_type, pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["doc_id", "th", "lo", "hi"])

        for batch in batches:
            for anchor, segment, doc, th, at, raw in zip(*(batch[c].to_pylist() for c in ("anchor", "segment", "doc_id", "th", "at", "raw"))):
                if (anchor, segment) == key:
                    continue
                if size >= settings.block and key is not None and anchor != key[0]:
                    yield solve()
                    block, size = [], 0
                key = (anchor, segment)
                block.append((doc, th, at, raw))
                size += len(raw)
        if block:
            yield solve()

    return run


def _hot_ranges(texts: DataFrame, settings: Settings, doc_type: pa.DataType, doc_sql: str) -> DataFrame:
    """The same for buckets too large for one task: strings grouped by hash."""
    length = settings.length

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, th, at, raw in zip(*(batch[c].to_pylist() for c in ("doc_id", "th", "at", "raw"))):
                n = len(raw) - length + 1
                digests = [xxhash.xxh3_128_intdigest(raw[k : k + length]) for k in range(n)]
                half = (1 << 64) - 1
                yield pa.RecordBatch.from_arrays([
                    pa.array([doc] * n, doc_type), pa.array([th] * n, pa.int64()), pa.array(range(at >> 8, (at >> 8) + n), pa.int64()),
                    pa.array([(d & half) - (1 << 63) for d in digests], pa.int64()), pa.array([(d >> 64) - (1 << 63) for d in digests], pa.int64()),
                ], names=["doc_id", "th", "lo", "h1", "h2"])

    strings = texts.dropDuplicates(["anchor", "segment"]).mapInArrow(cut, f"doc_id {doc_sql}, th long, lo long, h1 long, h2 long")
    twice = strings.groupBy(F.col("h1").alias("g1"), F.col("h2").alias("g2")).agg(F.count("*").alias("n")).where("n > 1")
    hits = strings.join(twice, (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2")))
    return hits.select("doc_id", "th", "lo", (F.col("lo") + length).alias("hi"))


def repeated_ranges(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, th and [lo, hi) in bytes of what goes; docs has doc_id, th (a hash of text) and text."""
    from pyspark.sql.pandas.types import to_arrow_type

    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType
    arrow, sql = to_arrow_type(kind), kind.simpleString()
    counted = docs.mapInArrow(_count_segments(settings), "anchor long, segment long, place long").groupBy("anchor", "segment")
    counted = materialise(counted.agg(F.count("*").alias("n"), F.min("place").alias("place")), "repeats-segments")
    crowded = counted.groupBy(F.col("anchor").alias("a")).agg(F.count("*").alias("m")).where("m > 1")
    crowded = materialise(crowded, "repeats-buckets")
    twice = materialise(counted.where("n > 1").select(F.col("anchor").alias("a"), F.col("segment").alias("s")), "repeats-twice")
    contested = counted.join(crowded, F.col("anchor") == F.col("a"), "left_semi").select(F.col("place").alias("key"))
    bitmaps = _bitmap(twice.select(F.expr("a ^ s").alias("key")), settings.bits), _bitmap(contested, settings.bits)
    shared = spark.sparkContext.broadcast(bitmaps)
    drop_table(counted)

    fields = f"anchor long, segment long, doc_id {sql}, th long, at long, raw binary"
    picked = materialise(docs.mapInArrow(_pick_segments(shared, settings, arrow), fields), "repeats-picked")
    whole = picked.where("raw is null").join(twice, (F.col("anchor") == F.col("a")) & (F.col("segment") == F.col("s")))
    start = F.shiftright("at", 8)
    whole = whole.select("doc_id", "th", start.alias("lo"), (start + F.col("at").bitwiseAND(255) + settings.length - 1).alias("hi"))

    texts = picked.where("raw is not null")
    hot = crowded.where(F.col("m") > settings.bucket).select("a")
    found = []
    if not hot.isEmpty():
        is_hot = F.col("anchor") == F.col("a")
        found = [_hot_ranges(texts.join(hot, is_hot, "left_semi"), settings, arrow, sql)]
        texts = texts.join(hot, is_hot, "left_anti")
    texts = texts.repartition("anchor").sortWithinPartitions("anchor", "segment")
    ranges = f"doc_id {sql}, th long, lo long, hi long"
    found += [materialise(texts.mapInArrow(_sorted_buckets(settings, arrow), ranges), "repeats-sorted"), materialise(whole, "repeats-whole")]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _remove(text: str | None, ranges: list[dict]) -> tuple[int, int, int, str]:
    raw = (text or "").encode()
    spans: list[list[int]] = []
    for lo, hi in sorted((r["lo"], r["hi"]) for r in ranges):
        if spans and lo <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], hi)
        else:
            spans.append([lo, hi])
    digest, at = hashlib.sha256(), 0
    for lo, hi in spans:
        digest.update(raw[at:lo])
        at = hi
    digest.update(raw[at:])
    return len(raw), sum(hi - lo for lo, hi in spans), len(spans), digest.hexdigest()


def remove_repeats(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the digest of the bytes that stay, for every row."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind = docs.schema["doc_id"].dataType
    arrow, sql = to_arrow_type(kind), kind.simpleString()
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("th", F.xxhash64("text"))
    ranges = repeated_ranges(rows, settings)
    ranges = ranges.groupBy(F.col("doc_id").alias("d"), F.col("th").alias("t")).agg(F.collect_set(F.struct("lo", "hi")).alias("ranges"))
    joined = rows.join(ranges, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("t")), "left").select("doc_id", "text", "ranges")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [_remove(t, r or []) for t, r in zip(batch["text"].to_pylist(), batch["ranges"].to_pylist())]
            columns = list(zip(*out)) or [[]] * 4
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"].cast(arrow), *(pa.array(c, t) for c, t in zip(columns, types))],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )

    return joined.mapInArrow(run, f"doc_id {sql}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
