"""Names found by weak supervision: precision and recall on planted texts that the model hasn't seen, gazetteers, unusual texts."""

import random
import time

import pytest
from pyspark.sql import functions as F

from orespark.llm import pii

FILLER = ["The", "old", "rock", "was", "cut.", "Then", "water", "ran", "Under", "stone", "and", "In", "summer", "it", "dried.", "Apache",
    "License", "applies.", "May", "rain", "fell."]
#: Planted sentences: text before the name, kind, what a name is made of.
PLANTED = [("My name is ", "person", "gf"), ("Signed by ", "person", "gf"), ("Yesterday we met ", "person", "Gf"), ("Please ask Mr. ", "person", "f"),
    ("Dr ", "person", "f"), ("Dear ", "person", "g"), ("She lives in ", "place", "c"), ("He was born in ", "place", "c"),
    ("They work for ", "employer", "fe"), ("He is employed by ", "employer", "fe")]
#: Sentences without a name, some of them traps.
CLEAN = ["Dear Customer, thank you.", "He was born in March and left.", "Grace is needed.", "The General Public License applies.",
    "Works at night are loud.", "The city: small.", "Ask the doctor. Mr. or Mrs. is a title.", "We sailed to Victoria Falls once."]


def made(kinds, rng):
    """A name: g any given name, G a listed one, f a family name, c a city, e a company's ending."""
    syllable = lambda: rng.choice("bdfgklmnprstvz") + rng.choice("aeiou")
    of = {"g": lambda: rng.choice([*sorted(pii.GIVEN), syllable().title() + syllable() + "n"]), "G": lambda: rng.choice(sorted(pii.GIVEN)),
        "f": lambda: syllable().title() + syllable() + syllable() + "k", "c": lambda: rng.choice([*sorted(pii.CITIES), syllable().title() + syllable() + "ville"]),
        "e": lambda: rng.choice(["Ltd", "GmbH", "Inc"])}
    return " ".join(of[k]() for k in kinds)


def corpus(n, seed):
    rng, rows = random.Random(seed), []
    for i in range(n):
        text, spans = "", set()
        for _ in range(rng.randint(1, 6)):
            text += " ".join(rng.choices(FILLER, k=rng.randint(3, 20))) + ".\n"
            if rng.random() < 0.5:
                before, kind, parts = rng.choice(PLANTED)
                name = made(parts, rng)
                spans.add((kind, len(text + before), len(text + before + name)))
                text += before + name + ", as said. "
            elif rng.random() < 0.3:
                text += rng.choice(CLEAN) + " "
        rows.append((i, text, spans))
    return rows


def spans_of(row):
    return {(k, int(a), int(b)) for k, a, b in (x.split(":") for x in row.spans.split(",") if x)}


def test_names_of_unseen_texts(spark):
    frame = lambda rows: spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    model = pii.train(frame(corpus(800, 1)))
    held = corpus(400, 2)
    found = {r.doc_id: spans_of(r) for r in pii.find(frame(held), model).collect()}
    right = sum(len(found[i] & want) for i, _, want in held)
    precision, recall = right / sum(map(len, found.values())), right / sum(len(want) for *_, want in held)
    print(f"names: precision {precision:.3f}, recall {recall:.3f}")
    assert precision >= 0.95 and recall >= 0.95
    assert set(model.reliability) == set(pii.NAMES)
    clean = pii.redact(frame(held), model).filter("doc_id < 50").collect()
    for r in clean:
        _, text, _ = held[r.doc_id]
        assert r.text == pii.redacted(text, sorted(found[r.doc_id]))


def test_no_names(spark):
    rows = [(i, t) for i, t in enumerate([*CLEAN[:-1], "", None, "Of " * 2000, "A" * 100_000, "The Apache License. In May Of Us All."])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert pii.train(docs).weights is None
    model = pii.train(spark.createDataFrame([r[:2] for r in corpus(300, 3)], "doc_id long, text string"))
    assert [r.spans for r in pii.find(docs, model).collect()] == [""] * len(rows)


def test_gazetteer_from_a_table(spark):
    entries = spark.createDataFrame([("person", "Zorvan"), ("person", " Zorvan "), ("place", "Ulm"), ("planet", "Mars"), ("person", None), ("person", ""),
        (None, "Ann"), ("employer", "Orebody")], "kind string, name string").withColumn("names", F.lit("clash"))
    known = pii.gazetteer(entries)
    assert "Zorvan" in known["person"] and "Anna" in known["person"] and "Ulm" in known["place"] and known["employer"] == {"Orebody"}
    assert not any("Mars" in v or "" in v for v in known.values())
    with pytest.raises(ValueError, match="more than 2"):
        pii.gazetteer(entries, max_entries=2)
    assert pii.gazetteer(entries.limit(0)) == pii.KNOWN
    text = "we saw Zorvan Kletok there"
    assert not pii.candidates(text, []) and [c.span for c in pii.candidates(text, [], known)] == [("person", 7, 20)]


def test_runs_of_any_length():
    for t in ("Anna " * 200_000, "A-" * 500_000, "Mr. " * 200_000, "my name is " * 100_000, "A" * 10**6, "Dear Dear " * 100_000):
        began = time.time()
        found = pii.candidates(t, [])
        assert time.time() - began < 30 and all(a < b for c in found for _, a, b in [c.span])
