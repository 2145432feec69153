"""What the methods add beyond the fixed patterns, against plain versions and planted cases."""

import math
import random
import string
from collections import Counter

import numpy as np

from weftline.llm import decontaminate, mixing, pii
from weftline.llm.secret_scan import added_spans, base_spans, entropy_spans
from tests.llm.test_secrets import ALLOW, drawn

DRAW = random.Random(5)
WORDS = ["".join(DRAW.choice("bcdfgklmnprst") + DRAW.choice("aeiou") for _ in range(DRAW.randint(2, 4))) for _ in range(900)]


def prose(n):
    return " ".join(DRAW.choice(WORDS) for _ in range(n))


def bits(s):
    return -sum(c / len(s) * math.log2(c / len(s)) for c in Counter(s).values())


def test_incremental_entropy_is_the_entropy_of_every_window():
    for _ in range(200):
        s = drawn(DRAW.choice(["ab", "abcdef0123", string.ascii_letters + string.digits]), DRAW.randint(0, 60))
        window, least = DRAW.randint(2, 24), DRAW.uniform(0.5, 4.0)
        inside = set()
        for i in range(len(s) - window + 1):
            if bits(s[i : i + window]) >= least - 1e-9:
                inside |= set(range(i, i + window))
        assert {p for a, b in entropy_spans(s, window, least) for p in range(a, b)} == inside


def test_secrets_are_told_from_identifiers():
    """Recall on random keys and false positives on names, paths and prose."""
    alphabets = (string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/", string.ascii_uppercase + "234567", string.ascii_lowercase + string.digits)
    keys = [drawn(DRAW.choice(alphabets), 40) for _ in range(200)]
    hit = sum(bool(added_spans(t := f"use {k} now", base_spans(t), ALLOW)) for k in keys)
    names = ["_".join(DRAW.sample(WORDS, 4)) for _ in range(100)] + ["".join(w.title() for w in DRAW.sample(WORDS, 4)) for _ in range(100)] + ["/".join(DRAW.sample(WORDS, 5)) for _ in range(100)]
    wrong = sum(bool(added_spans(t := f"see {n} here", base_spans(t), ALLOW)) for n in names)
    assert hit >= 190 and wrong <= 3, (hit, wrong)


def test_terms_that_stand_by_one_entity_disclose_it(spark):
    """Three planted terms, one of them among words of 500 characters; no other term."""
    secret, far, number = "Zorblaxian", "Quintrelle", "778812"
    long = "x" * 500
    rows = [prose(400) for _ in range(120)]
    rows += [f"{prose(30)} {secret} {prose(1)} mail kim.stone@example.org about {number} {prose(30)}" for _ in range(5)]
    rows += [f"{prose(9)} {far} {' '.join(long + c for c in 'abcd')} call +47 22 33 44 55 then {prose(20)}" for _ in range(5)]
    rows += [None, "", "kim.stone@example.org"]
    got = {r.doc_id: r for r in pii.sanitise(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()}
    terms = Counter(rows[i][int(s.split(":")[1]) : int(s.split(":")[2])] for i, r in got.items() for s in r.spans.split(",") if s.startswith("term"))
    assert terms[secret] == 5 and terms[far] == 5 and terms[number] == 5
    assert set(terms) - {secret, far, number} <= {long + c for c in "abcd"} | {"mail", "about", "call", "then"}
    assert all(secret not in r.clean and number not in r.clean for r in got.values() if r.clean)
    assert "<EMAIL>" in got[120].clean and got[125].n_phone == 1 and got[len(rows) - 3].clean is None


def test_thousands_of_spans(spark):
    text = " ".join(f"user{i}@example.org" for i in range(6000))
    r = pii.sanitise(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert r.n_email == 6000 and r.clean.count("<EMAIL>") == 6000


def leaks(spark, docs, items):
    d = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    b = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    return {(r.doc_id, r.item_id): r.reworded for r in decontaminate.leaks(d, b).collect()}


def test_short_items_and_longer_slots(spark):
    short = "What is the capital of France?"
    item = "A crew from Oslo needs 3 hours to load the crates while the crew from Bergen needs 7 hours for all of the same crates together"
    docs = [
        f"{prose(20)}. {short} {prose(20)}",
        f"{prose(20)}. What is the capital of Chile? {prose(20)}",
        prose(60),
        item.replace("3 hours", "three hours"),
        item.replace("Oslo", "New York").replace("Bergen", "Saint Petersburg"),
        item.replace("crates", "boxes").replace("hours", "days").replace("crew", "ship").replace("needs", "takes"),
    ]
    assert leaks(spark, docs, [short, item, "Yes, sir."]) == {(0, 0): False, (1, 0): True, (3, 1): False, (4, 1): True}


def test_pivotal_rounding_keeps_words_and_expectations():
    p, s = np.array([0.3, 0.6, 0.5, 0.0, 1.0, 0.25, 0.8]), np.array([10.0, 3.0, 7.0, 5.0, 4.0, 12.0, 1.0])
    mean = np.zeros(len(p))
    for seed in range(4000):
        out = mixing.pivot(p, s, np.random.default_rng(seed))
        assert abs((out * s).sum() - (p * s).sum()) < 1e-9 and ((out > 0) & (out < 1)).sum() <= 1 and out.min() >= 0 and out.max() <= 1
        mean += out
    assert np.abs(mean / 4000 - p).max() < 0.03
