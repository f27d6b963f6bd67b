"""Planted passages in several scripts, variants of an item, changed words, and a brute-force comparison."""

import random

import pytest

from lumenloom.llm import leakage

_LATIN = "abcdefghijklmnopqrstuvwxyz"
_CYRILLIC = "абвгдежзийклмнопрстуфхцчшщыэюя"


def _words(rng, n, alphabet, low=2, high=13):
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(low, high))) for _ in range(n)]


def _found(items, texts, budget=leakage.Budget()):
    stated = list(enumerate(items))
    common = leakage.Common(stated, budget, 6, 0.05, 5)
    return set(leakage.leaked(texts, leakage.Index(stated, common, budget), budget))


def _brute(items, texts, budget=leakage.Budget()):
    """Every item against every text along every diagonal of words."""
    stated = list(enumerate(items))
    common = leakage.Common(stated, budget, 6, 0.05, 5)
    index = leakage.Index(stated, common, budget)
    out = set()
    for d, text in enumerate(texts):
        words = leakage.words_of(text)
        for i in index.ids:
            shifts = range(-len(index.words[i]), len(words) + 1, 8)
            if any(leakage.aligned(index.words[i], index.masked[i], index.own[i], words, t, budget) for t in shifts):
                out.add((d, i))
    return out


@pytest.mark.parametrize("alphabet", [_LATIN, _CYRILLIC])
def test_copies_in_any_alphabet(alphabet):
    rng = random.Random(1)
    items = [" ".join(_words(rng, 60, alphabet if k < 5 else _LATIN)) for k in range(60)]
    texts = ["vorher " + t + " nachher" for t in items[:5]] + [" ".join(_words(rng, 200, alphabet)) for _ in range(20)]
    assert _found(items, texts) == {(k, k) for k in range(5)}


def test_copy_in_a_script_without_spaces():
    rng = random.Random(2)
    items = ["".join(chr(rng.randrange(0x4E00, 0x9F00)) for _ in range(200)) for _ in range(4)]
    changed = list(items[1])
    for k in range(0, 200, 9):
        changed[k] = "的"
    assert _found(items, [items[0], "".join(changed), items[2][:15], "".join(reversed(items[3]))]) == {(0, 0), (1, 1)}


def test_passage_of_variants_of_one_item():
    rng = random.Random(3)
    shared = _words(rng, 30, _LATIN)
    items = [" ".join(_words(rng, 40, _LATIN) + (shared if k < 3 else []) + _words(rng, 10, _LATIN)) for k in range(60)]
    altered = shared[:]
    altered[5], altered[17] = "qqq", "zzz"
    texts = [" ".join(shared), " ".join(altered), " ".join(shared[:15])]
    assert _found(items, texts) == {(d, i) for d in (0, 1) for i in range(3)}


def test_changed_words_of_every_length_are_never_lost():
    rng = random.Random(4)
    items = [" ".join(_words(rng, 50, _LATIN)) for _ in range(40)]
    texts, true = [], set()
    for d in range(300):
        i = rng.randrange(40)
        passage = items[i].split()[10:34]
        for k in rng.sample(range(1, 23), 3):
            passage[k] = _words(rng, 1, _LATIN)[0]
        texts.append(" ".join(_words(rng, rng.randint(0, 40), _LATIN) + passage + _words(rng, 20, _LATIN)))
        true.add((d, i))
    assert _found(items, texts) == true


def test_agrees_with_brute_force():
    rng = random.Random(5)
    items = [" ".join(_words(rng, 30, _LATIN)) for _ in range(12)]
    texts = []
    for _ in range(60):
        i, n = rng.randrange(12), rng.randint(12, 30)
        passage = items[i].split()[:n]
        for k in range(n):
            if rng.random() < 0.15:
                passage[k] = "x" * rng.randint(1, 9)
        texts.append(" ".join(_words(rng, 15, _LATIN) + passage))
    assert _found(items, texts) == _brute(items, texts)


def test_markup_case_hyphens_and_put_in_words():
    rng = random.Random(6)
    items = [" ".join(_words(rng, 40, _LATIN, 3, 9)) for _ in range(10)]
    passage = items[0].split()[:26]
    marked = "\n".join(f"> **{w.upper()}**," for w in passage)
    broken = " ".join(w[:2] + "-\n" + w[2:] if k % 5 == 0 else w for k, w in enumerate(passage))
    more = " ".join(w + " inserted" if k % 9 == 4 else w for k, w in enumerate(passage))
    assert _found(items, [marked, broken, more, " ".join(passage[:19])]) == {(0, 0), (1, 0), (2, 0)}


def test_sentences_of_one_pattern_are_no_copies():
    rng = random.Random(7)
    slots = [_words(rng, 400, _LATIN, 4, 8) for _ in range(6)]
    pattern = "before the {} gate opens two {} must be matched with the {} register and every {} without a number goes back to the {} ahead of {} today"
    fill = lambda: pattern.format(*[rng.choice(s) for s in slots])
    items = [fill() + " " + " ".join(_words(rng, 10, _LATIN)) for _ in range(60)]
    assert _found(items, [fill() for _ in range(40)]) == set()


def test_nulls_empties_and_a_bound_on_the_items(spark):
    documents = spark.createDataFrame([(1, None, 5), (2, "", 5), (3, "a b c", 5)], "doc_id long, text string, item_id int")
    items = spark.createDataFrame([(1, None), (2, ""), (3, "w " * 30)], "item_id long, text string")
    assert leakage.leaks(documents, items).count() == 0
    assert leakage.leaks(documents, items.limit(0)).count() == 0
    with pytest.raises(ValueError):
        leakage.leaks(documents, items, item_chars=10)
