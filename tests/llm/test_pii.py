import hashlib
import random
from collections import Counter

import pytest

from heirflow.llm import pii
from tests.llm import brute

TEXTS = [
    "a@b.c", "..a@b-c.d-e.", "a@b", "@a.b", "a@b.c@d.e", "x@y.z,q@r.s.t u@v..w", "a" * 3_000 + "@" + "b" * 50 + ".c",
    "1.2.3.4", "1.2.3.4.5.6.7.8", "01.002.0003.4", "256.1.1.1 1.1.1.256", "1.2.3", "999.1.2.3.4", "000000000000255.1.1.1",
    "4111111111111111", "4111 1111 1111 1111", "4111-1111-1111-1112", "1 2 3 4", "4111  1111", "0" * 14, "0" * 20,
    "+1 (555) 010-9999", "+15550109999", "+1", "+1-", "+1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6", "++1 555 010 9999 1", "+1" + " " * 400,
    "é mail ü@x.de é@y.fr \U0001F600 1.1.1.1", "", "9" * 4_000, ".1.1.1.1", "1..1.1.1.1",
]


@pytest.mark.parametrize("text", TEXTS)
def test_patterns(text):
    assert pii.base_spans(text) == brute.personal(text)


def test_report_against_brute_force(docs, rows):
    found = pii.pii_report(docs).collect()
    want = Counter()
    for key, text, *_ in rows:
        spans = brute.personal(text)
        digest = hashlib.sha256(",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in spans).encode()).hexdigest()
        want[(key, *[sum(s[1] == k for s in spans) for k in range(4)], digest)] += 1
    assert Counter(tuple(r)[:6] for r in found) == want


@pytest.fixture(scope="module")
def told(spark):
    """A nickname stands near one address in many contexts and nowhere else; common words stand everywhere."""
    fill = "river stone cloud window garden paper silver morning table letter".split()
    rows = [(i, f"{fill[i % 10]} {fill[i % 7]} zorblatt wrote from q.x@mail.org the {fill[i % 3]} {fill[i % 9]}") for i in range(12)]
    rows += [(100 + i, f"{fill[i % 10]} {fill[i % 7]} the {fill[i % 3]} {fill[i % 9]} wrote from home") for i in range(300)]
    rows += [(500 + i, "copied text with uniqueword near z.z@mail.org and no more") for i in range(9)]
    return spark.createDataFrame(rows + [(900, None), (901, "")], "doc_id long, text string").repartition(4)


@pytest.mark.parametrize("most", [0, 1_000])
def test_terms_that_give_a_value_away(told, most):
    found = {r.doc_id: r for r in pii.with_terms(told, max_terms=most).collect()}
    text = {r.doc_id: r.text for r in told.collect()}
    for i in range(12):
        terms = {text[i][s["start"] : s["stop"]] for s in found[i]["spans"] if s["kind"] == 4}
        assert "zorblatt" in terms and "the" not in terms
        assert [tuple(s) for s in found[i]["base"]] == brute.personal(text[i])
    # copies are one context, so their words prove nothing; texts without a value have no terms
    assert all(s["kind"] != 4 for i in (*range(100, 110), *range(500, 509)) for s in found[i]["spans"])


def test_two_contexts_count_beyond_chance(spark):
    """A name beside an address in two texts and nowhere else is proven by a large table; common words are not."""
    rows = [(1, "stone zorblatt wrote from q.x@mail.org the river"), (2, "cloud zorblatt asked about q.x@mail.org the window")]
    rows += [(10 + i, f"the garden {i} wrote paper and asked about silver from home") for i in range(2_000)]
    table = spark.createDataFrame(rows + [(5_000, "zorblatt zorblatt")], "doc_id long, text string").repartition(4)
    pairs = {(r.value, r.term) for r in pii.disclosing(table, pii.scan(table)).collect()}
    assert ("email:q.x@mail.org", "zorblatt") in pairs and ("email:q.x@mail.org", "the") not in pairs
    few = table.where("doc_id < 30")
    assert pii.disclosing(few, pii.scan(few)).count() == 0


def test_one_document_proves_nothing(spark):
    plain = [(k, f"the paper {k} says that silver window garden river {k % 7} the") for k in range(400)]
    told = "yesterday quixotic marmalade wrote a@b.org about gazebo the paper"
    for some in ([told], [told, told], [told, f"{told} gazebo a@b.org quixotic"[:len(told)]]):
        rows = plain + [(1_000, text) for text in some]
        table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        assert {r.text for r in pii.mask(table).where("doc_id = 1000").collect()} == {told.replace("a@b.org", "[EMAIL]")}
    once = plain + [(1_000, " ".join(["gazebo a@b.org quixotic", "stone gazebo met a@b.org", "a@b.org saw gazebo"]))]
    table = spark.createDataFrame(once, "doc_id long, text string")
    assert pii.disclosing(table, pii.scan(table)).count() == 0


@pytest.fixture(scope="module")
def people(spark):
    """Names beside addresses that share a local part or a domain, and a word that announces every address."""
    r = random.Random(6)
    words = [a + b for a in "river stone cloud window garden".split() for b in "er ing ly ous al ment ness".split()]
    rows = []
    for i in range(900):
        filler = lambda n: " ".join(r.choices(words, k=n))
        if i % 60 == 0:
            rows.append((i, f"{filler(9)} Jonquil, contact jon.q@host{i % 7}.example.org or {filler(9)}"))
        elif i % 30 == 1:
            rows.append((i, f"{filler(5)} acmecorp contact {words[i % 35]}{i}@acme.example.com {filler(4)} call +1 555 {i % 9}000 {i:04d} {filler(3)}"))
        elif i % 10 == 3:
            rows.append((i, f"{filler(3)} contact {words[i % 35]}{i}@mail{i % 11}.example.net {filler(3)} 10.0.{i % 5}.{i % 250}"))
        else:
            rows.append((i, filler(r.randint(0, 40))))
    rows += [rows[0], rows[60], (None, rows[120][1]), (950, None), (951, "")]
    return rows, spark.createDataFrame(rows, "doc_id long, text string").repartition(4)


def test_terms_against_brute_force(people, docs, rows):
    given, table = people
    for some, df in ((given, table), ([r[:2] for r in rows], docs)):
        found = Counter(
            (r.doc_id, tuple(tuple(s) for s in r.spans)) for r in pii.with_terms(df).collect()
        )
        want = Counter((key, tuple(sorted(brute.personal(text) + terms))) for (key, text), terms in zip(some, brute.term_spans(some)))
        assert found == want
    pairs = {(r.value, r.term) for r in pii.disclosing(table, pii.scan(table)).collect()}
    assert ("email-name:jon.q", "jonquil") in pairs and ("email-domain:acme.example.com", "acmecorp") in pairs
    assert all(term != "contact" for _, term in pairs)


def test_words_far_away_are_near_terms():
    text = "zorblatt " + "1 " * 400 + "a@b.c " + "2 " * 400 + "y" * 500 + " end"
    near = pii.near_terms(text, pii.base_spans(text))
    assert [(x["term"], text[x["start"] : x["stop"]]) for x in near] == [(w, w) for w in ("zorblatt", "y" * 500, "end")]
    cut = "éüö" + "ab@x.de" + "ßßß"
    assert [x["term"] for x in pii.near_terms(cut, pii.base_spans(cut))] == ["éüö", "ßßß"]


def test_masked_text(told, docs, clashing, no_docs):
    by_id = {r.doc_id: r.text for r in pii.mask(told).collect()}
    assert "[EMAIL]" in by_id[0] and "[TERM]" in by_id[0] and "zorblatt" not in by_id[0]
    assert by_id[900] is None and by_id[901] == "" and by_id[100].endswith("wrote from home")
    done = pii.mask(docs)
    assert done.columns == docs.columns and done.count() == docs.count()
    assert pii.mask(clashing).columns == clashing.columns
    assert pii.mask(no_docs).count() == 0 and pii.pii_report(no_docs).count() == 0
    assert pii.masked("abcdefgh", [(1, 2, 4), (3, 3, 5), (6, 0, 7)]) == "a[CARD]f[EMAIL]h"
