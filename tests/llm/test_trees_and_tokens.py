"""Merkle manifest, periodic runs, byte pairs."""

import hashlib
import json
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from siftmark.llm import byte_pairs, merkle, periodic_runs, queries

PATH = public_tokenizers.path("byte_bpe_50k.json")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# --- op11 ---------------------------------------------------------------------------------------------------


def brute_tree(digests, fan=8):
    """All levels of a tree, from the leaves to its top."""
    levels = [digests]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([sha("".join(last[i:i + fan])) for i in range(0, len(last), fan)])
    return levels


def brute_path(levels, place, fan=8):
    out = []
    for level in levels[:-1]:
        first = place // fan * fan
        run = level[first:first + fan]
        out.append(("".join(run[:place - first]), "".join(run[place - first + 1:])))
        place //= fan
    return out


def brute_manifest(rows):
    """rows: dicts of documents. Sorted (doc_id, leaf, subroot, root, path)."""
    def digest(row):
        values = [row[c] for c in ("doc_id", "source", "lang", "n_chars", "text")]
        return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))

    groups = {}
    for row in rows:
        groups.setdefault(row["lang"], []).append(((row["doc_id"] is not None, row["doc_id"] or 0, digest(row)), row["doc_id"]))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = [brute_tree([k[2] for k, _ in sorted(groups[g], key=lambda r: r[0])]) for g in names]
    top = brute_tree([t[-1][0] for t in trees])
    out = []
    for i, (g, tree) in enumerate(zip(names, trees)):
        for place, (key, doc) in enumerate(sorted(groups[g], key=lambda r: r[0])):
            out.append((doc, key[2], tree[-1][0], top[-1][0], tuple(brute_path(tree, place) + brute_path(top, i))))
    return sorted(out, key=repr)


def fold(path, digest):
    for left, right in path:
        digest = sha(left + digest + right)
    return digest


def document_leaf():
    return merkle.leaf([F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")])


def proofs_of(docs, settings=merkle.Settings(), wanted=None):
    manifest = merkle.build(docs, "lang", "doc_id", document_leaf(), [F.col("doc_id")], settings)
    rows = merkle.prove(manifest, wanted).collect()
    return sorted([(r.doc_id, r.leaf, r.subroot, r.root, tuple((s.left, s.right) for s in r.path)) for r in rows], key=repr)


@pytest.mark.parametrize("span, part", [(3, 4096), (1, 24), (2, 5)])
def test_merkle_proofs(spark, edge_docs, span, part):
    """Nulls, a null group, repeated rows, clashing columns; parts that are and are not aligned to runs."""
    docs = edge_docs.select("*", *[F.lit("x").alias(c) for c in ("tree", "idx", "digest", "row", "grp", "key", "tie", "leaf", "path", "root")])
    rows = [r.asDict() for r in docs.select("doc_id", "text", "lang", "source", "n_chars").collect()]
    got = proofs_of(docs, merkle.Settings(span=span, part=part))
    assert got == brute_manifest(rows)
    assert all(fold(path, leaf) == root for _, leaf, _, root, path in got)


def test_merkle_of_many_groups_and_subsets(spark):
    """More groups than a run, lone leaves, one large group, proofs of a few leaves only."""
    rows = [(i, f"t{i}", f"g{i % 40:02d}" if i < 60 else "big", "s", i) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    want = brute_manifest([r.asDict() for r in docs.collect()])
    few = proofs_of(docs, merkle.Settings(span=2, part=100), F.col("row.doc_id") % 37 == 0)
    assert few == [w for w in want if w[0] % 37 == 0] and len(few) == 17


def test_merkle_small_tables(spark, edge_docs):
    one = spark.createDataFrame([(7, "t", None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    [(doc, leaf, subroot, root, path)] = proofs_of(one)
    assert doc == 7 and leaf == subroot == root == sha("1:7---1:t") and path == ()
    assert proofs_of(edge_docs.limit(0)) == []


def test_missing_nodes_are_minimal():
    """No missing node is below or above a known leaf, and with them the root can be derived."""
    rng = random.Random(4)
    for _ in range(60):
        n = rng.randint(1, 700)
        levels = brute_tree([sha(str(i)) for i in range(n)])
        known = sorted(rng.sample(range(n), rng.randint(1, min(n, 40))))
        asked = [(level, int(i)) for level, places in merkle.missing(np.array(known), n, 8) for i in places]
        derivable = {(level, k // 8**level) for k in known for level in range(len(levels))}
        assert not set(asked) & derivable and len(asked) == len(set(asked))
        ways = merkle.expand({k: levels[0][k] for k in known}, {(l, i): levels[l][i] for l, i in asked}, n, 8)
        assert ways == {k: brute_path(levels, k) for k in known}


def test_merkle_query(spark, sf):
    got = {r.doc_id: r for r in queries.op11_merkle(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    want = {w[0]: w for w in brute_manifest([d.asDict() for d in docs])}
    for d in docs:
        doc, leaf, subroot, root, path = want[d.doc_id]
        text = d.text
        if text is not None and zlib.crc32(str(doc).encode()) % 3 == 0:
            text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        values = [doc, d.source, d.lang, d.n_chars, text]
        folded = fold(path, sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values)))
        proof = sha("".join(a + b for a, b in path))
        row = got[doc]
        assert (row.leaf, row.subroot, row.root, row.proof_sha256, row.folded_root, row.verified) == (leaf, subroot, root, proof, folded, folded == root)
    assert {r.verified for r in got.values()} == {True, False}


# --- op12 ---------------------------------------------------------------------------------------------------


def brute_runs(found, shortest=6, exponent=4):
    n, best = len(found), {}
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and found[j] == found[j + q]:
                j += 1
            if j > i and j - i + q >= max(shortest, exponent * q):
                best.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted([(s, l, q) for (s, l), q in best.items()], key=lambda r: (r[0], r[2]))


def brute_collapsed(found, runs):
    return " ".join(w for i, w in enumerate(found) if not any(s + q <= i < s + l for s, l, q in runs))


def periodic_words(rng):
    n = rng.choice([0, 1, 5, 6, 7, 20, 60, 150, 300])
    found = [f"w{rng.randrange(rng.choice([1, 2, 4, 60]))}" for _ in range(n)]
    for _ in range(rng.randint(0, 3)):
        if n > 10:
            a = rng.randrange(n)
            p = 1 + rng.randrange(max(1, (n - a) // 3))
            for i in range(a, min(n, a + p * rng.randint(2, 9) + rng.randrange(3))):
                found[i] = found[a + (i - a) % p]
    return found


def test_runs_against_brute_force():
    rng = random.Random(12)
    for _ in range(150):
        texts = [periodic_words(rng) for _ in range(rng.randint(1, 10))]
        numbers = [[{w: k for k, w in enumerate(dict.fromkeys(t))}[w] for w in t] for t in texts]
        assert periodic_runs.runs_of(numbers) == [brute_runs(t) for t in texts]


@given(st.lists(st.lists(st.sampled_from("aab"), max_size=40), max_size=4), st.integers(2, 5))
@settings(max_examples=150, deadline=None)
def test_runs_of_short_texts(texts, exponent):
    numbers = [[{w: k for k, w in enumerate(dict.fromkeys(t))}[w] for w in t] for t in texts]
    got = periodic_runs.runs_of(numbers, periodic_runs.Settings(exponent=exponent))
    assert got == [brute_runs(t, 6, exponent) for t in texts]


def test_extensions_against_brute_force():
    rng = np.random.default_rng(5)
    values = np.r_[rng.integers(0, 2, 300), np.tile(rng.integers(0, 3, 37), 12), np.zeros(200, int)].astype(np.int64)
    n = len(values)
    table = periodic_runs.Extensions(values)
    a = rng.integers(0, n - 1, 3000)
    b = a + 1 + (rng.random(3000) * (n - a - 1)).astype(np.int64)

    def common(x, y):
        k = 0
        while y + k < n and values[x + k] == values[y + k]:
            k += 1
        return k

    assert table.common(a, b).tolist() == [common(x, y) for x, y in zip(a.tolist(), b.tolist())]


def test_find_runs(spark, edge_docs):
    docs = edge_docs.select("*", *[F.lit("x").alias(c) for c in ("row", "runs", "collapsed")])
    got = sorted(periodic_runs.find_runs(docs, ["doc_id"], settings=periodic_runs.Settings(batch=2000)).collect(), key=repr)
    want = []
    for r in docs.select("doc_id", "text").collect():
        found = [w.decode() for w in (r.text or "").encode().split()]
        runs = brute_runs(found) if len(found) < 5000 else [(0, len(found), 1)]
        kept = brute_collapsed(found, runs) if len(found) < 5000 else found[0]
        want.append((r.doc_id, len(found), runs, kept))
    assert sorted([(r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in got], key=repr) == sorted(want, key=repr)
    assert periodic_runs.find_runs(docs.limit(0), ["doc_id"]).collect() == []


def test_periodic_runs_query(spark, sf):
    got = {r.doc_id: r for r in queries.op12_periodic_runs(spark, sf).collect()}
    planted = 0
    for d in spark.read.parquet(f"{sf}/documents.parquet").collect():
        found = [w.decode() for w in (d.text or "").encode().split()]
        h, n = zlib.crc32(str(d.doc_id).encode()), len(found)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            found = [w if i < a else found[a + (i - a) % p] for i, w in enumerate(found)]
            planted += 1
        runs = brute_runs(found)
        top = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=(None, None, None))
        row = got[d.doc_id]
        assert (row.n_runs, row.start, row.length, row.period) == (len(runs), *top)
        assert row.exponent_milli == (1000 * top[1] // top[2] if runs else None)
        assert row.runs_sha256 == sha("".join(f"{s},{l},{q}\n" for s, l, q in runs))
        assert row.collapsed_sha256 == sha(brute_collapsed(found, runs))
    assert planted > 5


# --- op13 ---------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def encoder():
    return byte_pairs.Encoder(byte_pairs.load(PATH))


def same(library, encoder, text):
    ids = library.encode(text, add_special_tokens=False).ids
    own = encoder.encode(text)
    assert np.frombuffer(own, "<u4").tolist() == ids, text
    assert byte_pairs.decode_ids(own, encoder.vocabulary.tokens) == library.decode(ids, skip_special_tokens=False)


def test_encoding_like_the_library(library, encoder):
    parts = [*"abcghst'reld \n\t  !?.,019é中ß", "<|endoftext|>", "'s", "'ll", "  ", " \n", "the", " and", " ", "　", " ", "\x85", "\x1c",
             "՘", "\U0001f600", "́", "﻿"]
    rng = random.Random(13)
    for _ in range(6000):
        same(library, encoder, "".join(rng.choice(parts) for _ in range(rng.randint(0, 30))))


@given(st.text(max_size=40))
@settings(max_examples=300, deadline=None)
def test_any_text_like_the_library(library, encoder, text):
    same(library, encoder, text)


def test_characters_like_the_library(library, encoder):
    """All characters below U+3000 and every 41st of the rest, each beside letters, digits, marks and blanks."""
    chars = [chr(c) for c in [*range(0x3000), *range(0x3000, 0x110000, 41)] if not 0xD800 <= c < 0xE000]
    for at in range(0, len(chars), 500):
        same(library, encoder, "".join(f"a{c}1{c}!{c} {c}\n" for c in chars[at:at + 500]))


def test_long_and_repetitive_texts(library, encoder):
    for text in ("a" * 3000, "ab" * 2000 + " " * 3000, " \n" * 500 + "x", "中" * 2000, "x1!" * 2000, "'" * 1000 + "s"):
        same(library, encoder, text)
    short = byte_pairs.Encoder(encoder.vocabulary, byte_pairs.Settings(piece=7, cached=50))
    rng = random.Random(3)
    for _ in range(800):
        same(library, short, "".join(rng.choice("ab \n é.") for _ in range(rng.randint(0, 80))))


def test_forced_pairs_are_inside_no_token(encoder):
    vocabulary = encoder.vocabulary
    inside = {t[i:i + 2] for t in vocabulary.tokens for i in range(len(t) - 1)}
    forced = vocabulary.forced
    assert all(forced[a << 8 | b] == (bytes((a, b)) not in inside) for a in range(256) for b in range(256))


def test_encode_and_decode_tables(spark, edge_docs, library):
    shared = byte_pairs.share(spark, byte_pairs.load(PATH))
    docs = edge_docs.select("*", F.lit("x").alias("ids"), F.lit("y").alias("row"), F.lit("z").alias("value"))
    encoded = byte_pairs.encode(docs, shared, ["doc_id"])
    texts = [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]
    want = sorted([(i, library.encode(t, add_special_tokens=False).ids) for i, t in texts], key=repr)
    assert sorted([(r.doc_id, np.frombuffer(r.ids, "<u4").tolist()) for r in encoded.collect()], key=repr) == want
    assert sorted(map(tuple, byte_pairs.decode(encoded, shared, ["doc_id"]).collect()), key=repr) == sorted(texts, key=repr)
    both = byte_pairs.encode(docs, shared, ["doc_id"], settings=byte_pairs.Settings(rows=7), decoded=True)
    assert sorted(((r.doc_id, r.decoded) for r in both.collect()), key=repr) == sorted(texts, key=repr)
    nothing = encoded.limit(1).select("doc_id", F.lit(None).cast("binary").alias("ids"))
    assert byte_pairs.decode(nothing, shared, ["doc_id"]).first().text == ""
    assert byte_pairs.encode(docs.limit(0), shared, ["doc_id"]).collect() == []


def test_unsupported_vocabularies(tmp_path):
    for name in ("word_bpe_49k.json",):
        with pytest.raises(ValueError):
            byte_pairs.load(public_tokenizers.path(name))
    spec = json.load(open(PATH, encoding="utf-8"))
    spec["pre_tokenizer"]["add_prefix_space"] = True
    (tmp_path / "t.json").write_text(json.dumps(spec))
    with pytest.raises(ValueError):
        byte_pairs.load(str(tmp_path / "t.json"))
