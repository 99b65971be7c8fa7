import random
import re
from collections import Counter

from pyspark.sql import functions as F

import gridloom.llm.truncation as T
from gridloom.llm.truncation import find_truncated, length_limits, word_events

DOCS = "doc_id bigint, text string, source string, n_chars bigint, score string, TEXT string"
WHO = ["The reviewer", "A courier", "Our operator", "The second desk", "Nobody", "The night crew"]
DID = ["checked", "renamed", "sorted", "returned", "measured", "counted"]
WHAT = ["the narrow tray", "every printed page", "an old manifest", "the blurred grid", "two folders", "the upper corner"]
WHEN = ["before the export started", "while the lamp flickered", "at noon", "after the second scan", "without any delay", "on the spare tablet"]


def sentence(rng):
    return f"{rng.choice(WHO)} {rng.choice(DID)} {rng.choice(WHAT)} {rng.choice(WHEN)}{rng.choice('.....!?')}"


def corpus(seed, n, limit=200):
    rng = random.Random(seed)
    out, cut = [], set()
    for i in range(n):
        text = " ".join(sentence(rng) for _ in range(rng.randint(1, 6)))
        declared = len(text)
        if rng.random() < 0.2:
            text += "\n\n" + rng.choice([f"-- desk {rng.randint(1, 9)}", f"Regards\nrv-{rng.randint(10, 99)}"])
            declared = len(text)
        source = rng.choice(["notes", "tickets"])
        if source == "notes" and len(text) > limit:
            text = text[:limit]
            declared = rng.choice([limit, declared])
            if text.rstrip()[-1] not in ".!?":
                cut.add(i)
        elif rng.random() < 0.04 and len(text) > 40:
            text = text[: rng.randint(20, len(text) - 8)]
            if text.rstrip()[-1] not in ".!?":
                cut.add(i)
        out.append((i, text, source, declared, "x", "y"))
    return out, cut


def test_held_out_accuracy(spark):
    data, cut = corpus(1, 2500)
    got = find_truncated(spark.createDataFrame(data, DOCS).repartition(6), train_rows=1500)
    found = {r["doc_id"] for r in got.scores.where("truncated").collect()}
    assert len(found & cut) / len(cut) > 0.9 and len(found & cut) / len(found) > 0.9
    rates = {r["source"]: r for r in got.rates.collect()}
    assert rates["notes"]["truncated"] > rates["tickets"]["truncated"] and rates["notes"]["docs"] + rates["tickets"]["docs"] == len(data)
    assert got.scores.count() == len(data)


def test_nulls_and_blanks(spark):
    data, _ = corpus(2, 200)
    odd = [(9001, None, "notes", None, "x", "y"), (9002, "", "notes", 0, "x", "y"), (9003, " \n", None, 2, "x", "y"), (9004, "word " * 60_000, None, 300_000, "x", "y"), (None, "No id here.", None, None, "x", "y")]
    got = find_truncated(spark.createDataFrame(data + odd, DOCS))
    rows = {r["doc_id"]: r for r in got.scores.collect()}
    assert all(rows[i]["score"] == 0 and not rows[i]["truncated"] for i in (9001, 9002, 9003)) and 0 <= rows[9004]["score"] <= 1 and None in rows
    assert {r["source"] for r in got.rates.collect()} == {"notes", "tickets", None}


def test_nothing_to_learn_from(spark):
    empty = find_truncated(spark.createDataFrame([], DOCS))
    assert empty.scores.count() == 0 and empty.rates.count() == 0
    one = find_truncated(spark.createDataFrame([(1, None, None, None, "x", "y")], DOCS))
    assert one.scores.first()["score"] == 0


def test_limits_and_events(spark):
    rows = [("s", 100)] * 30 + [("s", 60 + i % 80) for i in range(80)] + [(None, 50)] * 12 + [("few", 300)] * 5 + [("few", 40 + 9 * i) for i in range(20)]
    hist = spark.createDataFrame(rows, "source string, chars bigint").groupBy("source", "chars").agg(F.count("*").alias("n"))
    got = sorted((r["source"] or "", r["chars"]) for r in length_limits(hist).collect())
    assert got == [("", 50), ("few", 300), ("s", 100)]
    assert [e for _, e in word_events("One two. Three")] == [0, 1, 1]


def plain_events(text):
    """Word events as one would write them down."""
    out, before, found = [], "", list(re.finditer(r"\w+", text))
    for here, following in zip(found, found[1:], strict=False):
        w = re.sub(r"\d+", "0", here[0].lower())
        ends = bool(re.search(r"[.!?…][\"'”“’»)\]]*(\s|$)|\n|\r", text[here.end() : following.start()]))
        out += [(("", w), ends)] + ([((before, w), ends)] if before else [])
        before = "" if ends else w
    return out


def test_events_as_arrays_are_those_of_the_plain_form(monkeypatch):
    rng = random.Random(5)
    alphabet = ["word", "Wort", "x1", "2024", "3.5", "ż", " ", " ", "  ", ".", "!) ", "…", "\n", "\r\n", ",", "(", '"', "É", "_a", "٣", "\x00"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(300)]
    slots = {}
    for text in texts:  # words come before pairs, both in the order of the text
        want, got = sorted(plain_events(text), key=lambda e: e[0][0] != ""), word_events(text)
        assert [e for _, e in want] == [e for _, e in got], text
        for (key, _), (slot, _) in zip(want, got, strict=True):
            assert slots.setdefault(key, slot) == slot
    assert len(set(slots.values())) > 0.99 * len(slots)
    whole = Counter(e for text in texts for e in word_events(text))
    monkeypatch.setattr(T, "CHUNK", 50)
    monkeypatch.setattr(T, "MARGIN", 30)
    pieces = Counter()
    for part, low, high in T._pieces(texts):
        slot, ends = T._Words(part).events(low, high)
        pieces.update(zip(slot.tolist(), map(int, ends), strict=True))
    assert pieces == whole


def test_the_fit_takes_about_as_many_texts_as_it_was_told(spark):
    data, _ = corpus(3, 3000)
    same = [(10_000, "Sent again and again.", "notes", 21, "x", "y")] * 1500
    docs = spark.createDataFrame(data + same, DOCS)
    taken = []
    before = T._training_pairs

    def watch(sample, shared):
        taken.append(sample.count())
        return before(sample, shared)

    T._training_pairs = watch
    try:
        scores = find_truncated(docs, train_rows=800).scores
    finally:
        T._training_pairs = before
    assert 300 < taken[0] < 900
    assert scores.where("doc_id >= 10000").select("score").distinct().count() == 1
