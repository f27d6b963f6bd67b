"""Planted cuts in sources with ends of their own: recall and precision, and what the source decides."""

import random

from pyspark.sql import functions as F

from lumenloom.llm import truncation

_NOUNS = "report ledger reviewer harness archive token batch rubric score judge trace session window folder script".split()
_VERBS = "compared copied merged sorted archived skipped counted measured opened closed".split()


def _sentence(rng):
    return f"The {rng.choice(_NOUNS)} {rng.choice(_VERBS)} the {rng.choice(_NOUNS)} and left the {rng.choice(_NOUNS)} of the {rng.choice(_NOUNS)} unchanged."


def _text(rng, source):
    body = " ".join(_sentence(rng) for _ in range(rng.randint(2, 5)))
    kind = rng.randrange(4)
    if kind == 0:
        body += "\n\n" + "\n".join(f"- {rng.choice(_VERBS)} the {rng.choice(_NOUNS)}" for _ in range(4))
    elif kind == 1:
        body = '{"note": "' + body + '", "list": [1, 2, {"k": "v"}]}'
    elif kind == 2 and source == "mail":
        body += "\n\nBest wishes, the night desk"
    return body


def _cut(rng, text):
    """The text stopped inside a word or, of JSON, anywhere, with or without a mark behind it."""
    while True:
        at = rng.randint(len(text) // 3, len(text) - 3)
        if text[at - 1].isalpha() and text[at].isalpha() and text[at + 1].isalpha() and text[at - 2].isalpha():
            return text[:at] + rng.choice(["", "", "...", " [truncated]"])


def _judged(spark, texts):
    rows = spark.createDataFrame([(k, t, s) for k, (t, s, _) in enumerate(texts)], "doc_id long, text string, source string")
    probed = truncation.probe(truncation.values(rows, "documents", "doc_id", ["text"]))
    return {r["row_id"] for r in truncation.cut_values(probed).collect()}, probed


def test_recall_and_precision_of_planted_cuts(spark):
    rng = random.Random(11)
    texts = []
    for k in range(6000):
        source = "mail" if k % 3 == 0 else "notes"
        whole = _text(rng, source)
        texts.append((_cut(rng, whole), source, True) if k % 10 == 0 else (whole, source, False))
    found, probed = _judged(spark, texts)
    true = {k for k, t in enumerate(texts) if t[2]}
    recall, precision = len(found & true) / len(true), len(found & true) / len(found)
    assert recall >= 0.95 and precision >= 0.97, (recall, precision)
    rates = {r["source"]: r["share_cut"] for r in truncation.rates(probed, truncation.cut_values(probed)).collect()}
    assert all(0.07 < r < 0.13 for r in rates.values())


def test_an_end_that_one_source_uses_is_complete_there_only(spark):
    rng = random.Random(12)
    texts = []
    for k in range(9000):
        mail = k % 3 == 0
        texts.append((_sentence(rng) + ("\n\nBest wishes, the night desk" if mail and k % 6 == 0 else ""), "mail" if mail else "notes", False))
    texts += [(_sentence(rng) + " Then came the night desk", "notes", True) for _ in range(3)]
    texts += [(_sentence(rng) + f" {rng.choice(_NOUNS)} {a}{b} without an end", "notes", False) for a in "abcdefghij" for b in "klmnopqrst" for _ in range(40)]
    rows = spark.createDataFrame([(k, t, s) for k, (t, s, _) in enumerate(texts)], "doc_id long, text string, source string")
    probed = truncation.probe(truncation.values(rows, "documents", "doc_id", ["text"]))
    asked = probed.filter("what = 'ask'").groupBy("source").agg(F.count("*").alias("n"))
    cut = {r["row_id"] for r in truncation.cut_values(probed).collect()}
    assert {r["source"] for r in asked.collect()} == {"mail", "notes"}
    assert {9000, 9001, 9002} <= cut and not cut & {k for k in range(0, 9000, 6)}
