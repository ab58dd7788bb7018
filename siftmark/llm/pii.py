"""Personal data: patterns, and terms that give a protected value away.

Patterns find e-mail addresses, IP addresses, card and phone numbers. Around every find, the `reach` words
on each side in its line are its context. A context belongs to its value and to the owners that values share: the name
in an address (its local part without digits, roles like `info` aside) and the nearest name in the context.
Over the corpus, a term t that stands beside such an entity e in n(t,e) of its n(e) documents discloses  PMI(t; e) / IC(e)
of it, where PMI = log2(P(t|e) / P(t)), P(t) = n(t) / N, P(t|e) = (n(t,e) + prior P(t)) / (n(e) + prior), which
gives few contexts less weight, and IC = -log2(n(e) / N); n(t) and N count the distinct lines of all documents,
told apart by 64-bit hashes. Terms above `disclosure` with `support` documents or more become
spans in every line of every document: numbers and names are generalised, other words removed. A document counts
once however often it names the entity, and documents that repeat each other's contexts count as one, so copies
disclose nothing; a domain is no owner, since many people share it.

Defined results: null and empty texts have no spans. Repeated rows get equal spans. Finds that break a rule
(parts above 255, wrong digits) are dropped. Runs of any length take linear time. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F, types as T

from siftmark.llm.common import carried, materialise, restored

# The kinds in their order, those of the method last.
KINDS = ("email", "ip", "card", "phone", "number", "name", "term")
REPLACEMENT = {"email": "<EMAIL>", "ip": "<IP>", "card": "<CARD>", "phone": "<PHONE>", "number": "<NUMBER>", "name": "<NAME>", "term": ""}
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGIT = re.compile(r"[0-9]")
# A match can only begin where a run of digits does, which keeps long runs linear.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TERM = re.compile(r"\w{3,}")
_LETTERS = re.compile(r"[a-z]{2,}")
# Local parts that name no person.
_ROLES = frozenset("admin contact hello help hostmaster info mail noreply office postmaster reply sales service support team webmaster".split())
_BUCKETS = 1 << 20
_PARTS = 16


@dataclass(frozen=True)
class Settings:
    reach: int = 8
    support: int = 2
    prior: float = 1.0
    disclosure: float = 0.6


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Each @ with the longest local part before it that no earlier find has used."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            done = domain.end()
        at = text.find("@", max(done, at + 1))


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or 0) <= 255


def base_spans(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the patterns, by start and then by kind."""
    if not text:
        return []
    found = [(s, e, "email") for s, e in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        if "." in text:
            found += [(m.start(), m.end(), "ip") for m in _IP.finditer(text) if all(map(_octet, m[0].split(".")))]
        for m in _CARD.finditer(text):
            if 12 <= m.end() - m.start() <= 37:
                digits = m[0].replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and _luhn(digits):
                    found.append((m.start(), m.end(), "card"))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                    found.append((m.start(), m.end(), "phone"))
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def _near(text: str, start: int, end: int, reach: int, spans: list[tuple[int, int, str]]) -> list[tuple[str, int, int]]:
    """The terms beside a find, in its line: (term, start, end)."""
    width = 40 * reach
    low = max(text.rfind("\n", max(0, start - width), start) + 1, start - width, 0)
    cut = text.find("\n", end, end + width)
    high = cut if cut >= 0 else min(len(text), end + width)
    while low > 0 and low < start and text[low - 1].isalnum():
        low += 1  # not the rest of a word
    left = [(m[0], low + m.start(), low + m.end()) for m in _TERM.finditer(text[low:start])][-reach:]
    right = [(m[0], end + m.start(), end + m.end()) for m in _TERM.finditer(text[end:high])][:reach]
    return [t for t in left + right if not any(t[1] < e and s < t[2] for s, e, _ in spans)]


def kind_of(term: str) -> str:
    return "number" if term.isdigit() else "name" if term[:1].isupper() else "term"


def _entities(value: str, kind: str, terms: list[tuple[str, int, int]], start: int) -> list[str]:
    """The value, and the owners by which it belongs together with other values."""
    out = [f"{kind}:{value.lower()}"]
    if kind == "email":
        parts = [p for p in _LETTERS.findall(value.lower().split("@")[0].split("+")[0]) if p not in _ROLES]
        if parts:
            out.append("owner:" + ".".join(parts))
    names = [t for t in terms if kind_of(t[0]) == "name"]
    if names:
        out.append("name:" + min(names, key=lambda t: (max(start - t[2], t[1] - start), t[1]))[0].lower())
    return out


_RECORD = "spans array<struct<start:long,end:long,kind:string>>, beside array<struct<entity:string,term:string,context:long,doc:long>>"


def _records(keep: list[str], settings: Settings):
    spans_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))
    beside_type = pa.list_(pa.struct([("entity", pa.string()), ("term", pa.string()), ("context", pa.int64()), ("doc", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_spans, all_beside = [], []
            for text in (t.as_py() for t in batch["text"]):
                spans, beside = base_spans(text), []
                doc = xxhash.xxh64_intdigest(text) - (1 << 63) if spans else 0
                for start, end, kind in spans:
                    terms = _near(text, start, end, settings.reach, spans)
                    context = xxhash.xxh64_intdigest(" ".join(t[0].lower() for t in terms)) - (1 << 63)
                    for entity in _entities(text[start:end], kind, terms, start):
                        beside += [{"entity": entity, "term": t, "context": context, "doc": doc} for t in {t[0].lower() for t in terms}]
                all_spans.append([{"start": s, "end": e, "kind": k} for s, e, k in spans])
                all_beside.append(beside)
            yield pa.RecordBatch.from_arrays(
                [*(batch[c] for c in keep), pa.array(all_spans, spans_type), pa.array(all_beside, beside_type)],
                names=[*keep, "spans", "beside"],
            )

    return run


def records(docs: DataFrame, keep: list[str], settings: Settings = Settings()) -> DataFrame:
    """keep, the base spans and the terms beside them, written out; one row per row of docs."""
    names = keep if "text" in keep else [*keep, "text"]
    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return materialise(docs.select(*names).mapInArrow(_records(keep, settings), f"{fields}, {_RECORD}"), "pii-records")


def _line_terms(marked: np.ndarray):
    """The hash of every line, once per batch, and its terms in question."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines: dict[int, list[str]] = {}
            for text in batch["text"].to_pylist():
                for line in (text or "").lower().split("\n"):
                    h = xxhash.xxh64_intdigest(line) - (1 << 63)
                    if h not in lines:
                        lines[h] = [t for t in set(_TERM.findall(line)) if marked[xxhash.xxh32_intdigest(t) % _BUCKETS]]
            yield pa.RecordBatch.from_pydict({"h": pa.array(list(lines), pa.int64()), "t": pa.array(list(lines.values()), pa.list_(pa.string()))})

    return run


def disclosures(docs: DataFrame, found: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """entity, term of the pairs whose term gives the value away, by the co-occurrence of all documents."""
    spark = docs.sparkSession
    contexts = found.select(F.explode("beside").alias("b")).select("b.*")
    # One document stands for all that have the context, so copies are one.
    contexts = contexts.groupBy("entity", "term", "context").agg(F.min("doc").alias("doc"))
    pairs = contexts.select("entity", "term", "doc").distinct().groupBy("entity", "term").agg(F.count("*").alias("n_te"))
    pairs = pairs.where(f"n_te >= {settings.support}")
    entities = contexts.select("entity", "doc").distinct().groupBy(F.col("entity").alias("e")).agg(F.count("*").alias("n_e"))
    pairs = materialise(pairs.join(entities, F.col("entity") == F.col("e")).drop("e"), "pii-pairs")
    # Distinct lines of a part of the texts bound n(t) from below, all lines bound N from above: pairs that fail
    # even so, such as those of common words, need no exact count.
    most = docs.agg(F.sum(F.coalesce(F.length("text") - F.length(F.translate("text", "\n", "")), F.lit(0)) + 1)).first()[0]
    part = _line_counts(docs.where(F.pmod(F.xxhash64("text"), F.lit(_PARTS)) == 0), _marked(pairs), "pii-part")
    least = pairs.join(part, F.col("term") == F.col("t"), "left").withColumn("n_t", F.coalesce("n_t", F.lit(1)))
    pairs = materialise(least.where(_share(F.lit(float(most or 1)), settings) >= settings.disclosure).select(*pairs.columns), "pii-open")
    marked = _marked(pairs)
    if not marked.any():
        return pairs.select("entity", "term")
    lines = _line_counts(docs, marked, "pii-lines")
    n = F.lit(float(lines.where("t = ''").agg(F.sum("n_t")).first()[0]))
    joined = pairs.join(lines, F.col("term") == F.col("t"))
    return joined.where(_share(n, settings) >= settings.disclosure).select("entity", "term")


def _line_counts(docs: DataFrame, marked: np.ndarray, name: str) -> DataFrame:
    """t, n_t: the distinct lines that hold a term of the bitmap; those of the empty term are all lines."""
    shared = docs.sparkSession.sparkContext.broadcast(marked)
    lines = docs.select("text").mapInArrow(lambda b: _line_terms(shared.value)(b), "h long, t array<string>").groupBy("h").agg(F.first("t").alias("t"))
    lines = lines.select(F.explode(F.array_append("t", F.lit(""))).alias("t")).groupBy("t").agg(F.count("*").alias("n_t"))
    return materialise(lines, name)


def _share(n: Column, settings: Settings) -> Column:
    """PMI(t; e) / IC(e) of the columns n_te, n_t and n_e; it grows with n and falls with n_t."""
    rate = F.col("n_t") / n
    pmi = F.log2((F.col("n_te") + settings.prior * rate) / (F.col("n_e") + settings.prior) / rate)
    return pmi / F.greatest(-F.log2(F.col("n_e") / n), F.lit(1e-9))


def _marked(terms: DataFrame) -> np.ndarray:
    """A bitmap of fixed size that tells which terms may be among those of a frame."""
    marked = np.zeros(_BUCKETS, bool)
    marked[[r.b for r in terms.select("term").distinct().mapInArrow(_buckets, "b long").distinct().toLocalIterator()]] = True
    return marked


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_pydict({"b": pa.array([xxhash.xxh32_intdigest(t) % _BUCKETS for t in batch["term"].to_pylist()], pa.int64())})


def _occurrences(marked: np.ndarray):
    """Where texts hold terms of the bitmap outside their base spans."""
    names = ("k", "term", "start", "end", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known: dict[str, bool] = {}
            rows, seen = [], set()
            for key, text in zip(batch["_key"].to_pylist(), batch["text"].to_pylist()):
                if not text or key in seen:
                    continue
                seen.add(key)
                spans = None
                for m in _TERM.finditer(text):
                    word = m[0]
                    hit = known.get(word)
                    if hit is None:
                        hit = known[word] = bool(marked[xxhash.xxh32_intdigest(word.lower()) % _BUCKETS])
                    if hit:
                        spans = base_spans(text) if spans is None else spans
                        if not any(m.start() < e and s < m.end() for s, e, _ in spans):
                            rows.append((key, word.lower(), m.start(), m.end(), kind_of(word)))
            yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], schema=pa.schema(
                [("k", pa.string()), ("term", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]
            ))

    return run


def added_spans(docs: DataFrame, found: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """key and the spans that the method adds, for texts that have any; docs holds text and _key, a digest of it."""
    told = materialise(disclosures(docs, found, settings).select(F.col("term")).distinct(), "pii-terms")
    shared = docs.sparkSession.sparkContext.broadcast(_marked(told))
    fields = "k string, term string, start long, end long, kind string"
    places = docs.select("_key", "text").mapInArrow(lambda b: _occurrences(shared.value)(b), fields) if shared.value.any() else docs.sparkSession.createDataFrame([], fields)
    hits = places.join(told.withColumnRenamed("term", "t"), F.col("term") == F.col("t"))
    # Written out, so that the join on a digest which many copies share can be split.
    return materialise(hits.groupBy(F.col("k").alias("key")).agg(F.collect_set(F.struct("start", "end", "kind")).alias("more")), "pii-added")


def _texts(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def _summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns: dict[str, list] = {name: [] for name in ("n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")}
        for base, more in zip(batch["spans"].to_pylist(), batch["more"].to_pylist()):
            base = [(s["start"], s["end"], s["kind"]) for s in base]
            for kind in KINDS[:4]:
                columns[f"n_{kind}"].append(sum(s[2] == kind for s in base))
            columns["base_sha256"].append(hashlib.sha256(_texts(base).encode()).hexdigest())
            full = base + [(s["start"], s["end"], s["kind"]) for s in more or []]
            columns["spans"].append(_texts(sorted(full, key=lambda s: (s[0], KINDS.index(s[2])))))
        yield pa.RecordBatch.from_arrays(
            [batch["doc_id"], *(pa.array(columns[f"n_{k}"], pa.int64()) for k in KINDS[:4]),
             pa.array(columns["base_sha256"], pa.string()), pa.array(columns["spans"], pa.string())],
            names=["doc_id", *columns],
        )


def find_spans(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, counts of the base kinds, their digest, and all spans as text, for every row."""
    rows = docs.select("doc_id", "text", F.md5("text").alias("_key"))
    found = records(rows, ["doc_id", "_key"], settings)
    more = added_spans(rows, found, settings)
    joined = found.select("_key", "doc_id", "spans").join(more, F.col("_key") == F.col("key"), "left").select("doc_id", "spans", "more")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return joined.mapInArrow(_summary, f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redact(text: str | None, more: list[tuple[int, int, str]]) -> str | None:
    """The text with its personal data replaced; where spans overlap, the first one stands for both."""
    if not text:
        return text
    spans = sorted(base_spans(text) + more, key=lambda s: (s[0], KINDS.index(s[2])))
    out, at = [], 0
    for start, end, kind in spans:
        if start >= at:
            out += [text[at:start], REPLACEMENT[kind]]
        at = max(at, end)
    return "".join([*out, text[at:]])


def sanitise(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """docs with personal data in text generalised or removed, whatever other columns they have."""
    rows = materialise(carried(docs).withColumn("_key", F.md5("text")), "pii-documents")
    found = records(rows.select("text", "_key"), ["_key"], settings)
    more = added_spans(rows.select("text", "_key"), found, settings).select(F.col("key").alias("_of"), "more")
    joined = rows.join(more, F.col("_key") == F.col("_of"), "left").select("row", "text", "more")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [
                redact(t, [(s["start"], s["end"], s["kind"]) for s in more or []])
                for t, more in zip((t.as_py() for t in batch["text"]), batch["more"].to_pylist())
            ]
            yield pa.RecordBatch.from_arrays([batch["row"], pa.array(texts, pa.string())], names=["row", "clean"])

    schema = T.StructType([joined.schema["row"], T.StructField("clean", T.StringType())])
    return restored(joined.mapInArrow(run, schema), docs.columns, "clean")
