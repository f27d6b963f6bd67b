"""Evaluation passages inside training texts.

Both sides are reduced to their letters and digits, as code points of any script. Character q-grams that a
text shares with an item are counted in overlapping bands of diagonals. By the q-gram lemma a passage of the
least length within the edit budget keeps, in one band, at least the q-grams it has less those that the
longest words the budget may change can touch; that bound is taken from the real lengths of the words of
every passage, and bands below it are dropped unseen. What is left is aligned word by word in a band around
the diagonal. Only standing instructions that many items share are masked; every other q-gram counts.

Sentences of one pattern with other words in it keep the turns of phrase but not the places where they meet
the item's own words. An altered passage therefore needs evidence: pairs of neighbouring words that few items
have and that still stand side by side. A passage that stands word for word needs none.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Q = 8
_ESCAPES = {"n": " ", "t": " ", "r": " ", "f": " ", "b": " ", '"': '"', "/": "/", "\\": "\\", "'": "'"}
_ESCAPE = re.compile(r"\\(?:u([0-9a-fA-F]{4})|([ntrfb\"'/\\]))")
_TAG = re.compile(r"</?[A-Za-z][^<>\n]{0,80}>")
_HYPHEN = re.compile(r"(?<=\w)[-\u2010\u2011][ \t]*\n[\s*#>|]*(?=\w)")
_HIDDEN = re.compile("[\u00ad\u200b-\u200f\u202a-\u202e\u2060-\u2064\ufeff]")
#: Scripts written without spaces (fixed ranges of Unicode): each of their letters is a word.
_UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U000323af"
_WORD = re.compile(f"[{_UNSPACED}]|[^\\W_{_UNSPACED}]+")
_HIGH = re.compile("[\u0300-\U0010ffff]+")
_LETTER = re.compile(f"[{_UNSPACED}]")


def words_of(text: str) -> list[str]:
    """Words without case, marks, markup, escapes, line breaks and hyphenation."""
    if "\\" in text:
        text = _ESCAPE.sub(lambda m: chr(int(m[1], 16)) if m[1] else _ESCAPES[m[2]], text)
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = _TAG.sub(" ", text)
    text = _HIDDEN.sub("", text)
    if "\n" in text:
        text = _HYPHEN.sub("", text)
    if not text.isascii():
        text = _HIGH.sub(lambda m: "".join(c for c in m[0] if not unicodedata.combining(c)), unicodedata.normalize("NFKD", text))
    return _WORD.findall(text.casefold())


def spelled(words: list[str]) -> list[str]:
    """Words as they enter the q-grams: a letter that is a word is spelled with four signs, about a word's length."""
    if not _LETTER.search("".join(words)):
        return words
    return [
        w + chr(0xF0000 + (ord(w) & 0xFFF0)) + chr(0x100000 + (ord(w) & 0xFFF0)) + chr(0xF0000 + (ord(w) & 0xF)) if len(w) == 1 and _LETTER.match(w) else w for w in words
    ]


@dataclass(frozen=True)
class Budget:
    """A passage: the least number of consecutive item words, and the share of them that may be changed or put in.

    Evidence of an altered passage: `pairs` of the item's own word pairs whole and the share `kept` of those it
    has, or `few` of them and the share `most`. A pair is the item's own if at most `own` of all items, or
    `own_least` of them, have it.
    """

    words: int = 20
    share: float = 0.2
    pairs: int = 5
    few: int = 4
    kept: float = 0.5
    most: float = 0.65
    own: float = 0.02
    own_least: int = 8
    #: width of a band of diagonals: room on both sides for the words put in, 12 letters each
    band: int = 96

    def changes(self) -> int:
        return int(self.share * self.words)


def _units(spelling: list[str]) -> np.ndarray:
    return np.frombuffer("".join(spelling).encode("utf-32-le", "surrogatepass"), np.uint32)


def _grams(units: np.ndarray) -> np.ndarray:
    """All q-grams of an array of code points, as 64-bit hashes."""
    n = len(units) - Q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(Q):
        out *= np.uint64(0x100000001B3)
        out += units[k : n + k]
    out ^= out >> np.uint64(29)
    return out * np.uint64(0xBF58476D1CE4E5B9)


class Index:
    """The q-grams outside standing instructions of a block of items, with their places, and the own word pairs."""

    def __init__(self, items: list[tuple[int, str]], common: Common, budget: Budget) -> None:
        self.ids = [i for i, _ in items]
        self.words = [words_of(t) for _, t in items]
        self.masked = [common.standing(w) for w in self.words]
        self.own = [[k > 0 and not m[k] and not m[k - 1] and (w[k - 1], w[k]) not in common.pairs for k in range(len(w))] for w, m in zip(self.words, self.masked)]
        spellings = [spelled(w) for w in self.words]
        self.starts = [np.cumsum([0, *map(len, w)]) for w in spellings]
        #: least q-grams that a passage keeps within the budget, and that a passage has if it stands word for word
        self.need = np.full(len(items), 1 << 40, np.int64)
        self.whole = np.full(len(items), 1 << 40, np.int64)
        grams, item, place = [], [], []
        for k, (spelling, masked, starts) in enumerate(zip(spellings, self.masked, self.starts)):
            found = _grams(_units(spelling))
            seen = [j for j, m in enumerate(masked) if not m]
            if not len(found) or len(seen) < budget.words:
                continue
            clear = np.convolve(np.repeat(np.array(masked, bool), np.diff(starts)), np.ones(Q, int), "valid") == 0
            before = np.append(0, np.cumsum(clear))
            for a in range(len(seen) - budget.words + 1):
                passage = seen[a : a + budget.words]
                first, last = min(starts[passage[0]], len(found)), max(starts[passage[0]], starts[passage[-1] + 1] - Q + 1)
                has = int(before[min(last, len(found))] - before[first])
                spoiled = sorted((len(spelling[j]) + Q - 1 for j in passage), reverse=True)[: budget.changes()]
                self.need[k] = min(self.need[k], max(1, has - sum(spoiled)))
                self.whole[k] = min(self.whole[k], max(1, has))
            at = np.nonzero(clear)[0]
            grams.append(found[at])
            item.append(np.full(len(at), k, np.int32))
            place.append(at.astype(np.int32))
        grams_all = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        order = np.argsort(grams_all, kind="stable")
        self.item, self.place = (np.concatenate(x)[order] if x else np.zeros(0, np.int32) for x in (item, place))
        self.grams, self.first = np.unique(grams_all[order], return_index=True)
        self.count = np.diff(np.append(self.first, len(order)))
        self.sieve = np.zeros(1 << 22, bool)
        self.sieve[self._slot(self.grams)] = True
        self.vocabulary: dict[str, int] = {}
        number = lambda w: self.vocabulary.setdefault(w, len(self.vocabulary))
        own = [(number(w[j - 1]) << 32 | number(w[j]), k) for k, (w, o) in enumerate(zip(self.words, self.own)) for j in range(1, len(w)) if o[j]]
        pairs = np.array([p for p, _ in own], np.int64)
        order = np.argsort(pairs, kind="stable")
        self.pair_item = np.array([k for _, k in own], np.int64)[order]
        self.pairs, self.pair_first = np.unique(pairs[order], return_index=True)
        self.pair_count = np.diff(np.append(self.pair_first, len(order)))

    @staticmethod
    def _slot(grams: np.ndarray) -> np.ndarray:
        return (grams >> np.uint64(42)).astype(np.int64)

    def hits(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(position, item, place in the item) of every shared q-gram."""
        at = np.nonzero(self.sieve[self._slot(grams)])[0]
        if not len(at) or not len(self.grams):
            return (np.zeros(0, np.int64),) * 3
        slot = np.minimum(np.searchsorted(self.grams, grams[at]), len(self.grams) - 1)
        same = self.grams[slot] == grams[at]
        at, slot = at[same], slot[same]
        many = self.count[slot]
        entry = np.repeat(self.first[slot] - np.append(0, np.cumsum(many)[:-1]), many) + np.arange(many.sum())
        return np.repeat(at, many), self.item[entry].astype(np.int64), self.place[entry].astype(np.int64)

    def evidence(self, texts: list[list[str]]) -> np.ndarray:
        """For each text and item, flat, the number of the item's own word pairs that stand in the text."""
        out = np.zeros(len(texts) * len(self.ids), np.int64)
        if not len(self.pairs):
            return out
        known = self.vocabulary.get
        flat = np.array([known(w, -1) for words in texts for w in words], np.int64)
        doc = np.repeat(np.arange(len(texts)), [len(w) for w in texts])
        good = (flat[:-1] >= 0) & (flat[1:] >= 0) & (doc[:-1] == doc[1:])
        pair = (flat[:-1][good] << 32) | flat[1:][good]
        slot = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
        same = self.pairs[slot] == pair
        # each pair counts once for a text, as often as the item has it
        entry = np.unique(doc[:-1][good][same] * len(self.pairs) + slot[same])
        text, slot = entry // len(self.pairs), entry % len(self.pairs)
        many = self.pair_count[slot]
        where = np.repeat(self.pair_first[slot] - np.append(0, np.cumsum(many)[:-1]), many) + np.arange(many.sum())
        np.add.at(out, np.repeat(text, many) * len(self.ids) + self.pair_item[where], 1)
        return out


class Common:
    """What many items share: standing instructions (word runs), and word pairs of turns of phrase."""

    def __init__(self, items: list[tuple[int, str]], budget: Budget, run: int, share: float, least: int) -> None:
        self.run = run
        runs, pairs = Counter(), Counter()
        for _, text in items:
            words = words_of(text)
            runs.update({tuple(words[k : k + run]) for k in range(len(words) - run + 1)})
            pairs.update(set(zip(words, words[1:])))
        most = max(budget.own_least, budget.own * len(items))
        self.runs = {r for r, n in runs.items() if n >= least and n >= share * len(items)}
        self.pairs = {p for p, n in pairs.items() if n > most}

    def standing(self, words: list[str]) -> list[bool]:
        masked = [False] * len(words)
        for k in range(len(words) - self.run + 1):
            if tuple(words[k : k + self.run]) in self.runs:
                masked[k : k + self.run] = [True] * self.run
        return masked


def possible(item: list[str], masked: list[bool], there: set[str], budget: Budget) -> bool:
    """Whether any run of at least budget.words item words could stand in a text with these words within the budget.

    A run must have the share of its words in the text wherever they stand there: sums over the item's words
    rise over such a run, so it is enough to compare each sum with the lowest one that many words before.
    """
    sums, least = [0.0], float("inf")
    for word, hidden in zip(item, masked):
        if not hidden:
            sums.append(sums[-1] + (budget.share if word in there else budget.share - 1))
            if len(sums) > budget.words:
                least = min(least, sums[len(sums) - 1 - budget.words])
                if sums[-1] >= least - 1e-9:
                    return True
    return False


def aligned(item: list[str], masked: list[bool], own: list[bool], text: list[str], shift: int, budget: Budget, reach: int = 12) -> bool:
    """Whether a run of at least budget.words item words stands in the text around the diagonal `shift`.

    Local alignment in a band of words. At a high cost of wrong words a run begins where it is clean, at a low
    one it lives on through changes near its beginning; one of the two must find it.
    """
    return any(_run(item, masked, own, text, shift, budget, reach, gain, cost) for gain, cost in ((1, 2), (2, 1)))


def _run(item: list[str], masked: list[bool], own: list[bool], text: list[str], shift: int, budget: Budget, reach: int, gain: int, cost: int) -> bool:
    """One local alignment: a match gains `gain`, a changed, dropped or inserted word costs `cost`.

    Masked words neither gain nor count. A run with wrong words needs the evidence of the budget.
    """
    width = 2 * reach + 1
    # score, item words, wrong words, own pairs, own pairs kept, whether the last word matched
    none = (0, 0, 0, 0, 0, False)
    above, end, there = [none] * (width + 2), len(text), set(text)
    live = False
    for i, word in enumerate(item):
        if not live and word not in there:
            continue
        live = False
        row = [none] * (width + 2)
        counts, pair = 0 if masked[i] else 1, 1 if own[i] else 0
        begin = i + shift - 1 - reach
        for b in range(max(1, -begin), min(width + 1, end - begin)):
            found = word == text[begin + b]
            if not found and above[b] is none and above[b + 1] is none and row[b - 1] is none:
                continue  # nothing to carry on
            before = above[b]
            score, span, wrong, pairs, kept, last = before
            pairs += 0 if before is none else pair  # the pair in front of a run is not the run's
            if found:
                best = (score + gain * counts, span + counts, wrong, pairs, kept + (pair if last else 0), True)
                if best[1] >= budget.words and best[2] <= budget.share * best[1]:
                    enough = best[4] >= budget.few and best[4] >= budget.most * best[3] or best[4] >= budget.pairs and best[4] >= budget.kept * best[3]
                    if not best[2] or enough:
                        return True
            else:
                best = (score - cost, span + counts, wrong + 1, pairs, kept, False)
                score, span, wrong, pairs, kept, last = above[b + 1]  # item word dropped
                if score - cost > best[0]:
                    best = (score - cost, span + counts, wrong + 1, pairs + pair, kept, False)
                score, span, wrong, pairs, kept, last = row[b - 1]  # word inserted
                if score - cost > best[0]:
                    best = (score - cost, span, wrong + 1, pairs, kept, False)
                if best[0] <= 0:
                    best = none
            row[b] = best
            live = live or best is not none
        above = row
    return False


def leaked(texts: list[str], index: Index, budget: Budget) -> list[tuple[int, int]]:
    """(text number, item number) pairs of a list of texts."""
    words = [words_of(t) for t in texts]
    spellings = [spelled(w) for w in words]
    gap = "\0" * Q
    whole = _units([part for s in spellings for part in (*s, gap)])
    begins = np.cumsum([0, *[sum(map(len, s)) + Q for s in spellings]])
    at, item, place = index.hits(_grams(whole))
    if not len(at):
        return []
    doc = np.searchsorted(begins, at, side="right") - 1
    pair = doc * len(index.ids) + item
    at = at - begins[doc]
    # whatever the alignment may accept has own pairs, or a passage word for word in one band
    some = index.evidence(words) >= budget.few
    total = np.bincount(pair, minlength=len(some))
    need, all_of = np.tile(index.need, len(texts)), np.tile(index.whole, len(texts))
    hopeful = (total >= need) & (some | (total >= all_of))
    left = hopeful[pair]
    at, item, place, pair = at[left], item[left], place[left], pair[left]
    if not len(at):
        return []
    some = some[pair]
    base = 1 << 32
    diagonal = at - place + base
    found: dict[int, list[np.ndarray]] = {}
    half = budget.band // 2
    span = (int(diagonal.max()) + budget.band) // budget.band + 1
    low_span = int(diagonal.min()) // budget.band - 1
    width = span - low_span + 1
    for offset in (0, half):
        key = pair * width + (diagonal + offset) // budget.band - low_span
        order = np.argsort(key, kind="stable")
        keys, begin, count = np.unique(key[order], return_index=True, return_counts=True)
        head = order[begin]
        enough = (count >= index.need[item[head]]) & (some[head] | (count >= index.whole[item[head]]))
        for b, n in zip(begin[enough], count[enough]):
            found.setdefault(int(pair[order[b]]), []).append(order[b : b + n])
    out = []
    starts: dict[int, np.ndarray] = {}
    there: dict[int, set[str]] = {}
    for p, bands in found.items():
        d, i = divmod(p, len(index.ids))
        if d not in starts:
            starts[d], there[d] = np.cumsum([0, *map(len, spellings[d])]), set(words[d])
        if not possible(index.words[i], index.masked[i], there[d], budget):
            continue
        tried: list[int] = []
        for rows in bands:
            # the middle diagonal of the band, in words
            shifts = np.searchsorted(starts[d], at[rows], side="right") - np.searchsorted(index.starts[i], place[rows], side="right")
            shifts.sort()
            for shift in {int(shifts[len(shifts) // 2]), int(shifts[len(shifts) // 10]), int(shifts[-1 - len(shifts) // 10])}:
                if not any(abs(shift - t) <= 4 for t in tried):
                    tried.append(shift)
        if any(aligned(index.words[i], index.masked[i], index.own[i], words[d], t, budget) for t in tried):
            out.append((d, i))
    return out


def leaks(
    documents: DataFrame,
    items: DataFrame,
    budget: Budget = Budget(),
    run: int = 6,
    shared_share: float = 0.05,
    shared_least: int = 5,
    block_chars: int = 4_000_000,
    item_chars: int = 64_000_000,
) -> DataFrame:
    """Pairs (doc_id, item_id) of documents and the items a passage of which they hold.

    Items are a stated query set: their size is measured first, and a set beyond item_chars characters is an
    error that asks to split it, never a silent cut. They are indexed in blocks of at most block_chars
    characters, sent to the executors one after the other, against all documents. In scripts without spaces
    a letter counts as a word. A word run that `shared_least` items and a `shared_share` of them have is a
    standing instruction. Null and empty texts on either side give no pairs; repeated documents each give
    theirs. No shuffle.
    """
    known = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("text is not null")
    size = known.agg(F.sum(F.length("text"))).first()[0] or 0
    if size > item_chars:
        raise ValueError(f"{size} characters of items are more than {item_chars}: search them in parts")
    stated = sorted((int(r[0]), r[1]) for r in known.toLocalIterator())
    common = Common(stated, budget, run, shared_share, shared_least)
    blocks: list[list[tuple[int, str]]] = [[]]
    room = block_chars
    for item in stated:
        if blocks[-1] and len(item[1]) > room:
            blocks.append([])
            room = block_chars
        blocks[-1].append(item)
        room -= len(item[1])
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("text is not null")

    def search(block: list[tuple[int, str]]):
        def run_block(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            index = Index(block, common, budget)
            for batch in batches:
                ids, texts = batch["doc_id"].to_numpy(), batch["text"].tolist()
                out, begin, size = [], 0, 0
                for k, text in enumerate(texts):
                    size += len(text)
                    if size > 500_000 or k == len(texts) - 1:
                        out += [(ids[begin + d], index.ids[i]) for d, i in leaked(texts[begin : k + 1], index, budget)]
                        begin, size = k + 1, 0
                yield pd.DataFrame(out, columns=["doc_id", "item_id"])

        return rows.mapInPandas(run_block, "doc_id long, item_id long")

    return reduce(DataFrame.unionByName, [search(block) for block in blocks])


def report(found: DataFrame, items: DataFrame) -> DataFrame:
    """For each item: its split and category and the number of documents it leaked into (0 if none)."""
    hits = found.groupBy("item_id").agg(F.countDistinct("doc_id").alias("n_documents"))
    return items.select(F.col("item_id").cast("long").alias("item_id"), "split_name", "category").join(hits, "item_id", "left").fillna({"n_documents": 0})
