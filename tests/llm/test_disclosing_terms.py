"""Terms that disclose entities, against a plain count over a whole table."""

import collections
import math
import re

import pytest

from respeval.llm import pii
from respeval.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.01"
MAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
SECRET = r"(?<![A-Za-z0-9])(?=[A-Za-z]*[0-9])(?=[0-9]*[A-Za-z])[A-Za-z0-9]{32,}"
NUMBERS = [
    r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}",
    r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){15,18}(?![ -]?[0-9])",
    r"\+[0-9][ ().0-9-]+[0-9]",
]


def plain_ratios(texts, pattern, least, reach=pii.REACH):
    """PMI / IC of every term by places of words, for a kind whose matches are all valid."""
    blank = lambda m: " "
    total, near, contexts = collections.Counter(), collections.Counter(), collections.defaultdict(set)
    for line in (x for t in texts for x in t.split("\n")):
        outside = re.sub(SECRET, blank, re.sub(MAIL, blank, line))
        total.update(re.findall(r"[^\W\d_]+", outside.lower()))
        spans = [m.span() for m in re.finditer(pattern, line)]
        free = line
        for other in (MAIL, *NUMBERS, SECRET):
            free = re.sub(other, lambda m: " " * len(m.group()), free)
        for m in re.finditer(r"[^\W\d_]+", free):
            for s, e in spans:
                if (m.end() <= s and s - m.start() <= reach) or (m.start() >= e and m.end() - e <= reach):
                    near[m.group().lower()] += 1
                    contexts[m.group().lower()].add(line[s:e])
                    break
    share = sum(near.values()) / sum(total.values())
    return {
        t: math.log2(near[t] / total[t] / share) / -math.log2(share) for t in near if len(contexts[t]) >= least
    }


def test_ratios_on_a_whole_table(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    texts = [r["text"] or "" for r in docs.collect()]
    rows = pii.disclosing_terms(docs, least=3, generalise=-10.0).collect()
    for kind, pattern in (("secret", SECRET), ("email", MAIL)):
        made = {r["term"]: r["ratio"] for r in rows if r["kind"] == kind}
        plain = plain_ratios(texts, pattern, least=3)
        assert plain and set(made) == set(plain)
        assert all(made[t] == pytest.approx(plain[t], abs=1e-9) for t in made)
    disclosing = {(r["term"], r["kind"]) for r in rows if r["ratio"] >= pii.GENERALISE}
    assert ("token", "secret") in disclosing


def test_query_marks_terms(spark):
    rows = QUERIES["op6_pii"](spark, SMALL).collect()
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    assert sum(r["n_term"] for r in rows) >= 10
    for r in rows:
        spans = [x.split(":") for x in r["spans"].split(",") if x]
        assert len(spans) == r["n_spans"]
        terms = [(int(a), int(b)) for kind, a, b in spans if kind == "term"]
        assert [x.split(":")[1:] for x in r["term_actions"].split(",") if x] == [[str(a), str(b)] for a, b in terms]
        base = [(int(a), int(b)) for kind, a, b in spans if kind != "term"]
        assert not any(a < d and c < b for a, b in terms for c, d in base)
        if re.search(r"\btoken = \"[0-9a-f]{40}", texts[r["doc_id"]]):
            assert r["n_term"] and any(texts[r["doc_id"]][a:b] == "token" for a, b in terms)


def test_short_terms_and_pairs_of_characters(spark):
    mail = [f"電話邮箱 IP of {'abcdefghijklmnopqrst'[i % 20]}q: user{i}@example.com." for i in range(40)]
    plain = ["漢字文章 and more of it"] * 400
    docs = spark.createDataFrame([(t,) for t in mail + plain], "text string")
    found = {r["term"] for r in pii.disclosing_terms(docs).collect()}
    assert found == {"電話", "邮箱", "ip"}


def test_labels_stay_whole(spark):
    docs = spark.createDataFrame([("[Contact] a@b.co mail",), (None,), ("",), ("[email] \ufdd2",)], "text string")
    cleaned = pii.sanitised(docs, {"contact": "remove", "mail": "email", "email": "secret"}).collect()
    expected = {"[] [email] [email]", None, "", "[[secret]] \ufddf"}
    assert len(cleaned) == 4 and {r["text"] for r in cleaned} == expected


def test_many_entities_on_one_line(spark):
    line = " ".join(f"Zebulon user{i}@example.com" for i in range(4000))
    docs = spark.createDataFrame([(line,), ("nothing here " * 4000,)], "text string")
    terms = pii.action_table(pii.disclosing_terms(docs))
    assert [r["term"] for r in terms.collect()] == ["zebulon"]
    sizes = pii.with_all_spans(docs, terms).selectExpr("size(_term_) n").collect()
    assert sorted(r["n"] for r in sizes) == [0, 4000]
