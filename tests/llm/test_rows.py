"""Chat windows, mixing, personal data."""

import hashlib
import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from siftmark.llm import chat_windows, mixing, pii
from siftmark.llm.common import word_count

HARD = ["<|im_end|><|im_start|>assistant ok", r"<\|x", "<", "|im_end|>", r"\\<\\|", "", "a\nb", "ünï 😀"]


@pytest.fixture(scope="module")
def turns(spark):
    rng = random.Random(4)
    rows = []
    for c in range(12):
        n = 0
        if c % 3 == 0:
            rows.append((c, 0, "system", "be kind " + rng.choice(HARD)))
            n = 1
        for t in range(n, n + rng.randint(1, 40)):
            rows.append((c, t, "user" if t % 2 else "assistant", " ".join(rng.choices(["word", *HARD], k=rng.randint(0, 30)))))
    rows += [(50, 0, None, None), (50, None, "assistant", "last"), (51, 0, "assistant", "same"), (51, 0, "assistant", "same"),
             (52, 0, "system", "alone"), (53, 0, "odd\nrole%<|x|>", "text"), (None, 0, "user", "no id"), (54, 0, "assistant", "w " * 5000)]
    return rows


def ordered(rows):
    key = lambda r: (r[0] is not None, r[0] or 0, r[1] is None, r[1] or 0, r[2] or "", r[3] or "")
    return itertools.groupby(sorted(rows, key=key), key=lambda r: r[0])


@pytest.mark.parametrize("budget", [chat_windows.Budget(), chat_windows.Budget(120, 30, 60), chat_windows.Budget(40, 40, 40)])
def test_windows(spark, turns, budget):
    table = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("cell", F.lit("clash"))
    windows = chat_windows.format_windows(table, budget).cache()
    got = {r.conv_id: r for r in chat_windows.read_back(windows).collect()}
    for conv, rows in ordered(turns):
        rows = [(r[2] or "", r[3] or "") for r in rows]
        loss = "".join(t for role, t in rows if role == "assistant")
        r = got[conv]
        assert r.n_turns == len(rows) and r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in rows).encode()).hexdigest()
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        mine = sorted((w for w in windows.collect() if w.conv_id == conv), key=lambda w: w.first_turn)
        at = 0
        for w in mine:
            parsed = chat_windows.parse(w.formatted)
            assert w.first_turn == at and w.n_turns == len(parsed) - w.n_context
            assert w.n_tokens <= budget.window_tokens or w.over_budget or len(parsed) - w.n_context == 1
            if w.n_context:  # what is repeated is the system turn and the turns just before
                system = rows[:1] if rows[0][0] == "system" else []
                assert parsed[:w.n_context] == system + rows[at - (w.n_context - len(system)):at]
            at += w.n_turns
        assert at == len(rows)
    assert chat_windows.read_back(chat_windows.format_windows(table.limit(0), budget)).collect() == []


@pytest.mark.parametrize("text", HARD + ["".join(p) for p in itertools.product("<\\|", repeat=4)])
def test_escape_is_reversible(text):
    hidden = chat_windows.escape(text)
    assert "<|" not in hidden and chat_windows.unescape(hidden) == text


def brute_targets(sizes):
    """sizes: source -> words."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [s for s in sizes if s is None]
    weight = {s: [5, 2, 1][i % 3] for i, s in enumerate(names)}
    fixed, target = set(), {}
    while True:
        left = sum(sizes.values()) - sum(3 * sizes[s] for s in fixed)
        share = sum(weight[s] for s in names if s not in fixed)
        target = {s: 3 * sizes[s] if s in fixed else left * weight[s] / share for s in names}
        over = {s for s in names if s not in fixed and target[s] > 3 * sizes[s]}
        if not over:
            return target
        fixed |= over


def test_mix(spark, edge_docs):
    got = mixing.mix_sources(edge_docs, word_count(F.col("text")))
    rows = got.collect()
    assert len(rows) == edge_docs.count() and {"doc_id", "text", "size", "target", "taken"} <= set(got.columns)
    sizes = {}
    for r in rows:
        assert r.size == len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
        sizes[r.source] = sizes.get(r.source, 0) + r.size
    want = brute_targets(sizes)
    for source, total in sizes.items():
        mine = [r for r in rows if r.source == source]
        assert all(r.source_size == total and r.target == pytest.approx(want[source]) for r in mine)
        assert all(r.taken == r.copies * r.size and 0 <= r.copies <= 3 for r in mine)
        # Repeated rows are taken together, so a cut may miss by the copies of one document.
        assert abs(sum(r.taken for r in mine) - want[source]) <= 3 * max([r.size for r in mine] + [1])
    again = mixing.mix_sources(edge_docs.repartition(5), word_count(F.col("text"))).collect()
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.source or "", r.text or "")
    assert [r.taken for r in sorted(rows, key=key)] == [r.taken for r in sorted(again, key=key)]
    assert mixing.mix_sources(edge_docs.limit(0), word_count(F.col("text"))).collect() == []


def test_mix_comes_near_its_targets(spark):
    rng = random.Random(9)
    rows = [(i, f"s{min(rng.randint(0, 8), 5)}", int(rng.paretovariate(1.3) * 20)) for i in range(4000)]
    got = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, source string, n long"), F.col("n"))
    for r in got.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.max("size").alias("most")).collect():
        assert abs(r.taken - r.target) <= max(0.005 * r.target, r.most / 2)


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def digits(text):
    return re.sub("[^0-9]", "", text)


def luhn(number):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(number))) % 10 == 0


def brute_spans(text):
    text = text or ""
    found = [(m.start(), m.end(), "email") for m in EMAIL.finditer(text)]
    found += [(m.start(), m.end(), "ip") for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    found += [(m.start(), m.end(), "card") for m in CARD.finditer(text) if 12 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    found += [(m.start(), m.end(), "phone") for m in PHONE.finditer(text) if 9 <= len(digits(m[0])) <= 15]
    return sorted(found, key=lambda s: (s[0], pii.KINDS.index(s[2])))


def test_base_spans_of_random_texts():
    rng = random.Random(2)
    parts = ["a", "Z9", "@", "@@", ".", "..", "-", "+", " ", "1", "255", "256", "007", "4111 1111 1111 1111", "4111-1111-1111-1111", "+1 (555) 010-9999", "x@y.z", "é", "\n", "%", "10.0.0.1"]
    for _ in range(4000):
        text = "".join(rng.choices(parts, k=rng.randint(0, 14)))
        assert pii.base_spans(text) == brute_spans(text), text
    assert pii.base_spans("1" * 300000) == [] and pii.base_spans("a" * 300000 + "@") == []


def test_find_spans(spark, edge_docs):
    extra = spark.createDataFrame([(9100, "mail x@y.org or +1 (555) 010-9999")], "doc_id long, text string")
    docs = edge_docs.unionByName(extra, allowMissingColumns=True)
    rows = {(r.doc_id, r.text) for r in docs.collect()}
    got = pii.find_spans(docs).collect()
    assert len(got) == docs.count()
    want = {}
    for i, text in rows:
        want.setdefault(i, set()).add(hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, e, k in brute_spans(text)).encode()).hexdigest())
    assert all(r.base_sha256 in want[r.doc_id] for r in got)
    assert pii.find_spans(docs.limit(0)).collect() == []


@pytest.fixture(scope="module")
def telling_docs(spark):
    """Zorbulon stands beside one address again and again; ordinary words stand everywhere."""
    rng = random.Random(6)
    common = [f"plain{i}" for i in range(30)]
    rows = []
    for i in range(300):
        line = rng.choices(common, k=12)
        if i < 12:
            line[5:5] = ["Zorbulon", "ann@corp.example", "keeps"]
        rows.append((i, " ".join(line) + "."))
    return rows + [(900 + i, "Copied Quux stands by bob@corp.example here.") for i in range(20)] + [(990, None), (991, "")]


def test_disclosing_terms(spark, telling_docs):
    docs = spark.createDataFrame(telling_docs, "doc_id long, text string").withColumn("more", F.lit("clash"))
    got = {r.doc_id: r.spans for r in pii.find_spans(docs).collect()}
    text = dict(telling_docs)
    for i in range(12):
        at = text[i].index("Zorbulon")
        assert f"name:{at}:{at + 8}" in got[i] and "email:" in got[i]
        assert "plain" not in [text[i][int(s.split(":")[1]):int(s.split(":")[2])] for s in got[i].split(",")]
    assert all(got[900 + i].count(":") == 2 for i in range(20))  # copies of one line disclose nothing
    clean = {r.doc_id: r for r in pii.sanitise(docs).collect()}
    assert "Zorbulon" not in clean[0].text and "<NAME>" in clean[0].text and "<EMAIL>" in clean[0].text and "plain" in clean[0].text
    assert clean[900].text == "Copied Quux stands by <EMAIL> here." and clean[990].text is None and clean[0].more == "clash"
    assert clean[100].text == text[100]


def test_copies_do_not_hide_a_disclosing_term(spark):
    """A name that stands only beside one address discloses it, however many copies each line has."""
    rng = random.Random(7)
    rows = [" ".join(rng.choices([f"plain{i}" for i in range(30)], k=12)) for _ in range(400)]
    rows += [f"Quagnix takes mail{i} at amy@corp.example on day{i} of week{i}" for i in range(3) for _ in range(300)]
    got = pii.find_spans(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).where("doc_id >= 400").collect()
    assert len(got) == 900 and all("name:0:7" in r.spans.split(",") for r in got)


def test_disclosing_terms_go_everywhere(spark):
    """Terms go from lines without the value as well, and values of one owner that occur once each count together."""
    rng = random.Random(8)
    rows = [" ".join(rng.choices([f"plain{i}" for i in range(30)], k=12)) for _ in range(400)]
    rows += [f"{a} Trelvane {b} {c} writes" for a, b, c in (("from", "lou@one.example", "today"), ("by", "+1 (555) 010-9999", "again"), ("of", "10.1.2.3", "later"))]
    rows += [f"seen{i} in town{i} at {v} as kimborough" for i, v in enumerate(("kim.oak7@a.example", "kim.oak91@b.example"))]
    rows += ["Here Trelvane walks alone", "and kimborough sits", None]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    clean = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert clean[405] == "Here <NAME> walks alone" and clean[406] == "and  sits" and clean[407] is None
    assert not any("Trelvane" in t or "kimborough" in t for t in clean.values() if t)
    assert all(clean[i] == rows[i] for i in range(400))
