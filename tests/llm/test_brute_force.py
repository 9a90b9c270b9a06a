"""Every query that SQL cannot express, against a plain version over whole tables."""

import collections
import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from oracle import connect, differences
from pyspark.sql import functions as F

from respeval.llm import licenses, mixing, pii, substrings
from respeval.llm.components import components
from respeval.llm.minhash import PERMUTATIONS, near_duplicates, signatures
from respeval.llm.oracles import ORACLES
from respeval.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"
LARGE = "/root/testdata/sf0.1"
BLANKS = r"[\x20\x09-\x0D]+"


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}


def words(text):
    return [w for w in re.split(BLANKS, text) if w]


def folded(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text)


def shingles(text, k):
    w = words(folded(text))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} - {()}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_with_sql(spark, name):
    assert differences(QUERIES[name](spark, SMALL), connect(SMALL), ORACLES[name]) is None


def linked(sets, percent=80):
    root = {i: i for i in sets}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                low, high = sorted((top(a), top(b)))
                root[high] = low
    return {i: top(i) for i in ids}


def test_near_duplicates(spark, texts):
    sets = {i: shingles(t, 2) for i, t in texts.items()}
    expected = linked(sets)
    for r in QUERIES["op3_minhash"](spark, SMALL).collect():
        i = r["doc_id"]
        assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[i]), expected[i], expected[i] == i)


def test_large_bucket_of_loose_copies(spark):
    """A base and copies with ever more of it replaced, more than a small bucket holds."""
    rng = np.random.default_rng(3)
    base = [f"b{i}" for i in range(120)]
    made = []
    for i in range(150):
        copy = list(base)
        for at in rng.choice(120, size=i % 12, replace=False):
            copy[at] = f"n{rng.integers(40)}"
        made.append((i, " ".join(copy)))
    expected = linked({i: shingles(t, 2) for i, t in made})
    docs = spark.createDataFrame(made, "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in near_duplicates(docs, words=2).collect()} == expected


def test_min_and_max_estimate_similarity():
    rng = np.random.default_rng(1)
    common, a, b = (rng.integers(1 << 62, size=n).astype(np.uint64) for n in (800, 100, 100))
    sets = [np.unique(np.concatenate([common, x])) for x in (a, b)]
    low, high = signatures(np.concatenate(sets), np.array([0, len(sets[0]), len(sets[0]) + len(sets[1])]))
    agree = ((low[:, 0] == low[:, 1]).mean() + (high[:, 0] == high[:, 1]).mean()) / 2
    assert low.shape == (PERMUTATIONS, 2) and abs(agree - 0.8) < 0.12


def test_components_of_a_chain(spark):
    links = spark.range(60).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    links = links.unionAll(spark.createDataFrame([(100, 101), (101, 100), (5, 5)], "a long, b long"))
    found = {r["node"]: r["component"] for r in components(links).collect()}
    assert found == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def valid(kind, match):
    digits = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(p) <= 255 for p in match.split("."))
    if kind == "card":
        total = sum(
            v - 9 if (v := int(c) * (1 + i % 2)) > 9 else v for i, c in enumerate(reversed(digits))
        )
        return 16 <= len(digits) <= 19 and total % 10 == 0
    return kind == "email" or 8 <= len(digits) <= 15


def plain_spans(text):
    return [
        f"{k}:{m.start()}:{m.end()}"
        for k, p in PATTERNS.items()
        for m in re.finditer(p, text)
        if valid(k, m.group())
    ]


def test_personal_data(spark, texts):
    for r in QUERIES["op6_pii"](spark, SMALL).collect():
        expected = plain_spans(texts[r["doc_id"]])
        assert hashlib.sha256(",".join(expected).encode()).hexdigest() == r["base_sha256"]
        assert [s for s in r["spans"].split(",") if s and not s.startswith("term")] == expected


def test_personal_data_in_odd_texts(spark):
    odd = [
        "a@b.com_x@y.org", "1.2.3.4.5.6.7.8", "999.1.1.1.1.1.1", "x@y", "0001.2.3.0255 é a.b@c-d.e.f.",
        "4111 1111 1111 1111", "4111-1111-1111-11112", "1 4111111111111111", "+1 (555) 123-4567)", "+12", "++1-234-567-89.",
        "\U0001f600 a@b.co 漢 +49 30 1234567 10.0.0.1", "﷐a@b.co﷑", "7" * 400, "a." * 3000 + "@b.c", "a@" + "b." * 3000 + "c", None, "",
        " ".join(f"{i}.1.2.3" for i in range(600)),
    ]
    docs = spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string")
    for r in pii.with_all_spans(docs, {}).select("doc_id", pii.joined_spans(pii.KINDS).alias("s")).collect():
        assert r["s"] == ",".join(plain_spans(odd[r["doc_id"]] or "")), odd[r["doc_id"]]


def test_terms_that_disclose(spark):
    plain = [f"ordinary line number {'abcdefgh'[i % 8] * 4} here" for i in range(400)]
    mail = [f"Contact address somebody{i}@example.com here" for i in range(40)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(plain + mail)], "doc_id long, text string")
    terms = {r["term"]: r for r in pii.disclosing_terms(docs).collect()}
    assert set(terms) == {"contact", "address"} and terms["contact"]["ratio"] == pytest.approx(1.0)
    actions = pii.term_actions(pii.disclosing_terms(docs))
    assert actions == {"contact": "remove", "address": "remove"}
    last = pii.with_all_spans(docs, actions).where("doc_id = 400")
    assert last.select(pii.joined_spans(["email", "term"])).first()[0] == "email:16:37,term:0:7,term:8:15"
    cleaned = pii.sanitised(docs, {"contact": "remove", "address": "email"}).where("doc_id = 400").first()
    assert cleaned["text"] == " [email] [email] here" and cleaned.__fields__ == docs.columns


def cut_repeats(data, length=200):
    counts = collections.Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if counts[d[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        kept = bytes(c for c, g in zip(d, gone) if not g)
        yield len(d), sum(gone), spans, hashlib.sha256(kept).hexdigest()


def test_repeated_passages(spark, texts):
    ids = sorted(texts)
    expected = dict(zip(ids, cut_repeats([texts[i].encode() for i in ids])))
    for r in QUERIES["op7_suffix_array"](spark, SMALL).collect():
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == expected[r["doc_id"]]


@pytest.mark.parametrize("max_segments", [2, 1 << 14])
def test_repeated_passages_of_odd_texts(spark, max_segments):
    rng = np.random.default_rng(5)
    passage = "".join(rng.choice(list("abcdefgh é"), 260))
    other = "".join(rng.choice(list("abcdefgh "), 230))
    odd = ["", None, "a" * 1000, "ab" * 300, passage, other + "x" + passage, passage + other + passage]
    odd += ["".join(rng.choice(list("xyz "), 90)) + passage + str(i) for i in range(6)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(odd)], "doc_id long, text string")
    expected = list(cut_repeats([(t or "").encode() for t in odd]))
    for r in substrings.without_repeats(docs, max_segments=max_segments).collect():
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == expected[r["doc_id"]]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="abc", max_size=25), min_size=1, max_size=12))
def test_transform(documents):
    data = [d.encode() for d in documents]
    counts = collections.Counter(d[i : i + 4] for d in data for i in range(len(d) - 3))
    expected = [[i for i in range(len(d) - 3) if counts[d[i : i + 4]] > 1] for d in data]
    assert [list(x) for x in substrings.Transform(data, 4).repeats()] == expected


def measured(text):
    w = words(text)
    repeated = set()
    windows = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    for i in range(len(w) - 2):
        if windows[tuple(w[i : i + 3])] > 1:
            repeated.update(range(i, i + 3))
    lines = [x for x in text.split("\n") if words(x)]
    chars = sum(map(len, w))
    shares = []
    for k in range(5, 11):
        found = collections.Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
        inside = {j for i in range(len(w) - k + 1) if found[tuple(w[i : i + k])] > 1 for j in range(i, i + k)}
        shares.append(sum(len(w[j]) for j in inside) / max(chars, 1))
    symbols = sum(c in "#*$%&|<>" for c in text)
    return len(w), chars, symbols, len(lines) - len(set(lines)), len(repeated), shares


def test_quality_rules(spark, texts):
    for r in QUERIES["op10_quality_rules"](spark, SMALL).collect():
        n, chars, symbols, lines, repeat, shares = measured(texts[r["doc_id"]])
        assert tuple(r)[1:6] == (n, chars, symbols, lines, repeat)
        assert [r[f"coverage_{k}"] for k in range(5, 11)] == pytest.approx(shares)
        assert r["base_failed"] == (n < 50 or 100 * repeat > 50 * n)
        within = all(s <= m for s, m in zip(shares, (0.15, 0.14, 0.13, 0.12, 0.11, 0.10)))
        assert r["kept"] == (not r["base_failed"] and within and r["line_coverage"] <= 0.2)


def test_languages_of_held_out_rows(spark):
    docs = spark.read.parquet(f"{LARGE}/documents.parquet").select("doc_id", "lang")
    named = QUERIES["op5_language_id"](spark, LARGE).join(docs, "doc_id").where("held_out")
    right = named.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.99


def test_toxicity_of_held_out_rows(spark):
    labels = spark.read.parquet(f"{LARGE}/labels.parquet")
    scored = QUERIES["op4_toxicity"](spark, LARGE).join(labels, "doc_id").where("held_out")
    rows = [(r["predicted"], r["toxic"]) for r in scored.collect()]
    hits = sum(p and t for p, t in rows)
    assert hits / sum(t for _, t in rows) > 0.7 and hits / sum(p for p, _ in rows) > 0.95


def test_licences_in_texts(spark):
    docs = spark.read.parquet(f"{LARGE}/documents.parquet").limit(3000)
    notices = {n: f for f, all_of in licenses.NOTICES.items() for n in all_of}
    expected = {
        (r["doc_id"], f) for r in docs.collect() for n, f in notices.items() if n in (r["text"] or "")
    }
    found = {(r["doc_id"], r["family"]) for r in licenses.document_licenses(docs).collect()}
    assert expected and found == expected


def test_rates_meet_targets(spark):
    """The fitted rates against the same descent in numpy, and against the targets."""
    rows = [r.asDict() for r in QUERIES["op2_mixing"](spark, "/root/testdata/sf0.01").collect()]
    names = sorted(mixing.TARGETS)
    p = np.array([[r[f"p_{n}"] for n in names] for r in rows])
    tokens = np.array([r["n_tokens"] for r in rows], dtype=float)
    goal = np.array([mixing.TARGETS[n] for n in names])
    share = lambda rate: (rate * tokens) @ p / tokens.sum()
    moments = (p * tokens[:, None]).T @ p / tokens.sum()
    weight = 1 / share(np.ones(len(p)))
    rate, step = np.ones(len(p)), 1 / (moments.sum(axis=1) * weight).max()
    for _ in range(mixing.STEPS):
        gap = share(rate) - goal
        if np.abs(gap).max() <= mixing.TOLERANCE:
            break
        rate = np.maximum(0, rate - step * (p @ (weight * gap)))
    assert np.array([r["rate"] for r in rows]) == pytest.approx(rate, rel=1e-6, abs=1e-9)
    assert np.abs(share(rate) - goal).max() < np.abs(share(np.ones(len(p))) - goal).max() / 2
