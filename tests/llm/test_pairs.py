"""Operators that compare documents: SimHash, repeats, decontamination."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from siftmark.llm import decontaminate, repeats, simhash


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i:i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [b" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << j for j in range(64) if 2 * sum(h >> j & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    """prints: (id, fingerprint); the smallest id of the component of each."""
    nodes = sorted({p for _, p in prints})
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if (a ^ b).bit_count() <= 3:
                parent[find(a)] = find(b)
    first = {}
    for i, p in prints:
        if i is not None:
            first[find(p)] = min(first.get(find(p), i), i)
    return [first.get(find(p)) for _, p in prints]


def test_near_duplicates(spark, edge_docs):
    rows = edge_docs.select("doc_id", "text").collect()
    prints = [(r.doc_id, brute_fingerprint(r.text)) for r in rows]
    want = Counter((i, f"{p:016x}", c) for (i, p), c in zip(prints, brute_components(prints)))
    assert Counter(map(tuple, simhash.near_duplicates(edge_docs).collect())) == want
    assert simhash.near_duplicates(edge_docs.limit(0)).collect() == []
    kept = simhash.keep_first(edge_docs)
    assert kept.columns == edge_docs.columns
    groups = Counter(c for _, _, c in want)
    assert kept.count() == len(groups)


@pytest.mark.parametrize("bucket", [512, 3])
def test_links_of_crowded_fingerprints(spark, bucket):
    """Many fingerprints around a few centres: splitting crowded buckets loses no link."""
    rng = random.Random(bucket)
    found = set()
    for _ in range(3):
        centre = rng.getrandbits(64)
        for _ in range(60):
            x = centre
            for bit in rng.sample(range(64), rng.randint(0, 5)):
                x ^= 1 << bit
            found.add(x)
    signed = [x - (1 << 64) if x >> 63 else x for x in found]
    want = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 3}
    got = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), bucket=bucket).collect()
    assert len(got) == len(set(got)) and {tuple(r) for r in got} == want and want


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(1000, 1001), (5, 5)], "a long, b long")
    got = {r.node: r.root for r in simhash.components(edges).collect()}
    assert all(got[i] == 0 for i in range(1, 201)) and got[1001] == 1000


def brute_repeats(texts, length=200):
    raws = [(t or "").encode() for t in texts]
    counts = Counter(r[k:k + length] for r in raws for k in range(len(r) - length + 1))
    out = []
    for r in raws:
        gone = np.zeros(len(r) + 1, bool)
        for k in range(len(r) - length + 1):
            if counts[r[k:k + length]] > 1:
                gone[k:k + length] = True
        spans = int((np.diff(np.r_[False, gone].astype(int)) == 1).sum())
        kept = bytes(c for c, g in zip(r, gone) if not g)
        out.append((len(r), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.fixture(scope="module")
def overlapping_texts():
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdé ", k=rng.randint(1, 9)))
    passage = [" ".join(word() for _ in range(70)) for _ in range(4)]
    texts = [None, "", "short", "ab" * 400, "x" * 700, passage[0], passage[0]]
    for _ in range(60):
        parts = []
        for _ in range(rng.randint(1, 4)):
            p = rng.choice(passage)
            cut = rng.randint(0, len(p) // 2)
            parts += [" ".join(word() for _ in range(rng.randint(1, 40))), p[cut:cut + rng.randint(150, 400)]]
        texts.append("".join(parts))
    return texts


@pytest.mark.parametrize("settings", [
    repeats.Settings(), repeats.Settings(block=1000), repeats.Settings(bucket=1), repeats.Settings(bits=15),
], ids=["plain", "small blocks", "large buckets", "full bitmap"])
def test_repeats(spark, overlapping_texts, settings):
    rows = [(None if i == 5 else i, t) for i, t in enumerate(overlapping_texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_bytes", F.lit("clash")).repartition(3)
    got = Counter(tuple(r) for r in repeats.remove_repeats(docs, settings).collect())
    assert got == Counter((i, *w) for (i, _), w in zip(rows, brute_repeats(overlapping_texts)))
    assert repeats.remove_repeats(docs.limit(0), settings).collect() == []


def test_difference_cover():
    cover, step = repeats.difference_cover(32)
    for i in range(32):
        for j in range(32):
            assert cover[(i + step[i, j]) % 32] and cover[(j + step[i, j]) % 32]


def brute_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b):
            before, row[j + 1] = row[j + 1], before + 1 if x == y else max(row[j], row[j + 1])
    return row[-1]


def test_common_subsequence():
    rng = random.Random(3)
    for _ in range(200):
        a, b = (rng.choices("abcdef", k=rng.randint(1, 70)) for _ in range(2))
        assert decontaminate.common_subsequence(a, b) == brute_lcs(a, b)


@pytest.fixture(scope="module")
def benchmark_case(spark):
    rng = random.Random(8)
    vocabulary = ["".join(rng.choices("abdeilmnorstu", k=rng.randint(2, 8))) for _ in range(900)]
    prose = lambda n: rng.choices(vocabulary, k=n)
    items = [(i, prose(rng.randint(12, 60))) for i in range(30)] + [(30, prose(200))]
    rows, want = [], set()
    for d in range(120):
        words = prose(rng.randint(20, 400))
        if d % 4 == 0:
            item, passage = rng.choice(items)
            passage = list(passage)
            if d % 8 == 0:  # a paraphrase: some words change, the answer stays
                for k in rng.sample(range(len(passage) * 2 // 3), len(passage) // 6):
                    passage[k] = "changed"
            at = rng.randint(0, len(words))
            words[at:at] = passage
            want.add((d, item))
        rows.append((d, " ".join(words)))
    docs = spark.createDataFrame(rows + [(500, None), (501, ""), (502, "a b")], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items] + [(90, None), (91, "")], "item_id long, text string")
    return docs, bench, want


@pytest.mark.parametrize("settings", [decontaminate.Settings(), decontaminate.Settings(block=10, rank=16)], ids=["one block", "blocks"])
def test_leaks(spark, benchmark_case, settings):
    docs, bench, want = benchmark_case
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(docs, bench, settings).collect()}
    assert got == want
    kept = decontaminate.drop_leaks(docs.withColumn("cosine", F.lit("clash")), bench, settings)
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in docs.collect()} - {d for d, _ in want}


def test_leaks_of_nothing(spark, benchmark_case):
    docs, bench, _ = benchmark_case
    assert decontaminate.find_leaks(docs, bench.limit(0)).collect() == []
    assert decontaminate.find_leaks(docs.limit(0), bench).collect() == []
    assert decontaminate.drop_leaks(docs, bench.limit(0)).count() == docs.count()


def test_frequent_words_are_told_by_all_documents(spark):
    """A word that no sampled document holds is in the vocabulary as soon as enough documents hold it."""
    texts = [f"Common own{i} {'rare' * (i % 100 == 0)} {'scarce' * (i < 2)}" for i in range(300)]
    docs = spark.createDataFrame([*enumerate(texts), (900, None)], "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame([(1, "one passage of own7 and absent words")], "item_id long, text string")
    settings = decontaminate.Settings(sample_docs=1, common=1 / 100, task_words=50)
    counts, documents = decontaminate.word_counts(docs, settings)
    got = {r.w: r.n for r in counts.collect()}
    assert documents == 301 and got == {"common": 300, "rare": 3, "scarce": 2, **{f"own{i}": 1 for i in range(300)}}
    assert decontaminate.frequent_words(counts, documents, settings) == ["common"]  # a hundredth of 301 is more than three
    own = {"one", "passage", "of", "own7", "and", "absent", "words"}
    [[index]] = list(decontaminate._indices(docs, bench, decontaminate.Settings(sample_docs=1)))
    assert set(index.vocabulary) == own | {"common", "rare"}


def test_words_are_runs_of_word_characters():
    for code in (*range(0x2100), 0x4E2D, 0x1D538):
        text = f"Aa{chr(code)}b_9"
        assert decontaminate.words_of(text) == re.findall(r"\w+", text.lower()), hex(code)


def test_recall_of_the_search_against_exact_cosines(spark):
    """A full block of passages over skewed words: nearly all windows at cosine 0.2 or more are candidates."""
    rng = random.Random(21)
    vocabulary, weights = [f"w{i}" for i in range(4000)], [1 / (i + 2) ** 0.9 for i in range(4000)]
    prose = lambda n: rng.choices(vocabulary, weights, k=n)
    items = [prose(rng.randint(15, 40)) for _ in range(256)]
    texts = []
    for i in range(400):
        words = prose(rng.randint(30, 150))
        if i % 2 == 0:
            part = rng.choice(items)
            words[5:5] = part[: len(part) // 2]
        texts.append(words)
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    settings = decontaminate.Settings(sample_docs=200)
    [[index]] = list(decontaminate._indices(docs, bench, settings))
    assert len(index.passages) == 256
    rows = [decontaminate._row(words, index.vocabulary, index.idf) for _, words, _ in index.passages]
    matrix = np.zeros((len(index.idf), 256))
    for j, (ids, values) in enumerate(rows):
        matrix[ids, j] = values
    near, found = 0, 0
    for words in texts:
        got = {(w, j) for w, j, _ in decontaminate.candidates(words, index, settings)}
        for window in range(max(1, -(-len(words) // settings.half) - 1)):
            part = words[window * settings.half : window * settings.half + 2 * settings.half]
            counts = Counter(index.vocabulary.get(w, 0) for w in part)
            vector = np.array([n * index.idf[i] for i, n in counts.items()])
            cosines = (vector[:, None] * matrix[list(counts)]).sum(axis=0) / np.linalg.norm(vector)
            for j in np.flatnonzero(cosines >= settings.cosine).tolist():
                near += 1
                found += (window, j) in got
    print(f"recall {found}/{near}")
    assert near > 250 and found >= 0.97 * near
