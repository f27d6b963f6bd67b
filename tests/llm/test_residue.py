"""Planted residue beside foreign languages and plain documents; recall and precision on phrases outside the rules."""

import random

from lumenloom.llm import residue


def _found(spark, texts, source="site"):
    rows = [(k, t, source) for k, t in enumerate(texts)]
    return {r["doc_id"] for r in residue.residue(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}


def test_plain_and_foreign_sentences_are_no_filler(spark):
    texts = [
        "Reviewers compared retries across nightly batches. Token counts stayed unchanged overnight.",
        "Sędzia porównał wyniki wszystkich nocnych przebiegów. Liczba tokenów pozostała niezmieniona.",
        "Рецензент сравнил результаты ночных запусков. Количество токенов осталось прежним.",
        "Hakem gece koşularının sonuçlarını karşılaştırdı. Jeton sayıları değişmeden kaldı.",
        "Recenzent porovnal výsledky nočních běhů. Počty tokenů zůstaly beze změny.",
        "Arvioija vertasi öisten ajojen tuloksia keskenään. Merkkien määrä pysyi ennallaan.",
        "審査員は夜間の結果を比較した。トークン数は変わらなかった。",
    ]
    assert _found(spark, texts) == set()


def test_status_codes_and_connections(spark):
    texts = ["HTTP 451 Unavailable For Legal Reasons", "The connection was reset by the remote host.", "507 Insufficient Storage", "Status: 429", "This link has expired.", "ValueError: no such column"]
    assert _found(spark, texts) == set(range(6))


def test_page_with_any_amount_of_recurring_furniture(spark):
    menu = "\n".join(f"Read what the desk wrote about chapter {w} of the manual." for w in "one two three four five six seven eight nine ten eleven twelve thirteen fourteen".split())
    texts = [f"The run number {w} was archived in time and nobody was woken.\n{menu}" for w in "red green blue grey pink".split()] + [f"404 Not Found\n{menu}", f"404 Not Found\n{menu}\nThe reviewer wrote a page of notes."]
    assert _found(spark, texts) == {5}


def test_unknown_phrases_beside_notices_come_from_the_counts(spark):
    rng = random.Random(1)
    beside = ["Kindly ring the night desk about it.", "The gardener was informed and is on the way.", "Feel free to walk on to the next hall."]
    proof = ["Access denied.", "503 Service Unavailable", "Please enable JavaScript to view this page.", "Something went wrong."]
    true, texts = set(), []
    for k in range(400):
        if k % 10 == 0:
            texts.append(f"{rng.choice(proof)} {beside[k // 10 % 3]}")
            true.add(k)
        elif k % 10 == 1:  # content that speaks of an error
            own = " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(4))
            texts.append(f"The agent noted that access was denied to it. Then it opened {own} by another door.")
        else:
            texts.append(f"The {rng.choice(['tall', 'wide', 'calm'])} reader {chr(97 + k % 26)}{chr(97 + k // 26)} compared shelf {k} with the list and was content.")
    got = _found(spark, texts)
    assert len(got & true) / len(true) == 1.0 and len(got & true) / max(1, len(got)) == 1.0
    # without the others of the corpus nothing shows that these sentences are furniture
    assert _found(spark, ["Access denied. " + beside[0]]) == set()
