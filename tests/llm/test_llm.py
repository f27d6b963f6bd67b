"""Text operators: literal cases, brute force, exact agreement with a public library."""

import datetime as dt
import json
import random

import pytest

from lumenloom.llm import conversations, leakage, residue, tokenize, truncation

T0 = dt.datetime(2026, 3, 1, 10)


# p1 ---------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    "value",
    [
        '{"a": ["x", "y', '{"a": 1', "The loader stopped in the mid…", "Half a wor�", "a/b.py\nc/d", "Text ends here [truncated]", 'def f(x):\n    return load(x, "a',
        "Some text\n\n| a | b |\n|---|---|\n| 1 |", "```\ncode", "<html><body><p>Hi", "PASS a.py::x\nFAIL b.py::y", "one two, three,", "escape \\u00", "see docs/readme.",
    ],
)
def test_cut(value):
    assert truncation.judge(value)[0] in ("cut", "ask")
    assert truncation.judge(value)[0] == "cut" or "[truncated]" not in value


@pytest.mark.parametrize(
    "value",
    ["", "  ​", "A whole sentence.", '{"a": [1, {"b": "}"}]}', "It was marked [truncated], yet complete.", "Done. 👍🏽", "全部完了しました。", "PASS a::b\n3 passed in 1.20s", "(no output)",
     "x\n\n| a | b |\n|---|---|\n| 1 | 2 |", "Run this.\n\n```\ncode\n```", '<html><body><hr><p>x</p></body></html>', 'def f(x):\n    # Why.\n    return load(x, "a.go")\n', 'He said "stop."', "bla " * 50],
)
def test_whole(value):
    assert truncation.judge(value)[0] == "whole"


def documents(spark, texts, **more):
    rows = [(k, t, more.get("source", ["s"] * len(texts))[k], "x", 1) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, key string, n long")


def test_baseline_decides(spark):
    lines = ["- merged the cost report", "- copied the token count", "- sorted the rubric"]
    lists = [f"Notes {k}.\n\n" + "\n".join(lines[k % 3 :] + lines[: k % 3]) for k in range(30)]
    texts = [*lists, "Notes.\n\n- copied the token count\n- merged the cost", None, "", "It improved by 28.", *["It rose to 7 over 9. Next came more."] * 3, "x" * 200_000]
    rows = truncation.values(documents(spark, texts), "documents", "doc_id", ["text"])
    probed = truncation.probe(rows)
    cut = truncation.cut_values(probed)
    found = {r["row_id"] for r in cut.collect()}
    assert 30 in found and 33 in found and not found & {*range(30), 31, 32, 34, 35, 36}
    rate = truncation.rates(probed, cut).first()
    assert rate["n_values"] == len(texts) - 1 and rate["n_cut"] == len(found)
    assert truncation.cut_values(truncation.probe(rows.limit(0))).count() == 0


# p3 ---------------------------------------------------------------------------------------------------------

CHAT = "row_id long, session_id string, id string, reply_to string, role string, content string, timestamp string, received_at timestamp, mid string"


def chat(spark, rows):
    return spark.createDataFrame([(k, s, i, p, role, text, at, T0, "x") for k, (s, i, p, role, text, at) in enumerate(rows)], CHAT)


def test_conversations(spark):
    good = [
        ("a", "A1", None, "System", "Be kind", "2026-03-01T10:00:00Z"), ("a", "a2 ", "a1", " Human", "hi", "2026-03-01T12:00:01+02:00"), ("a", "a4", "a3", "bot", "done", "1772359203"),
        ("a", "a3", "A2", "function", "out", "2026-03-01T10:00:02.5Z"), ("a", "a2", "a1", "user", "hi again", "2026-03-01T10:00:01Z"),
    ]
    bad = [
        ("b", "b1", None, "user", "q", "2026-03-01T10:00:00Z"), ("b", "b2", "b1", "user", "q", "2026-03-01T10:00:01Z"), ("b", "b3", "b2", "assistant", "q", "2026-03-01T10:00:02Z"),
        ("c", "c1", None, "user", " ​ ", "1772359200000"), ("c", "c2", "c1", "assistant", "x", "1772359201000"),
        ("d", "d1", "gone", "user", "x", "1772359200"), ("d", "d2", "d1", "assistant", "x", "1772359201"),
        ("e", "e1", None, "assistant", "x", "1772359200"), ("e", "e2", "e1", "user", "x", "1772359201"), ("e", "e3", "e2", "ai", "x", "1772359202"),
        ("f", "f1", None, "user", "x", "yesterday"), ("f", "f2", "f1", "assistant", "x", "1772359202"), ("g", "g1", None, "nobody", "x", "1772359202"),
        (None, "h1", None, "user", "x", "1772359200"), ("i", "i1", None, "system", "x", "1772359200"),
    ]
    got = [(r["session_id"], r["turn_no"], r["row_id"]) for r in conversations.turns(chat(spark, good + bad)).collect()]
    assert sorted(got) == [("a", 1, 0), ("a", 2, 1), ("a", 3, 3), ("a", 4, 2)]
    assert conversations.turns(chat(spark, [])).count() == 0


def test_pointer_jumping_depth_orphans_and_cycles(spark):
    r = random.Random(5)
    n = 120
    up = {k: None if k == 0 else k - 1 for k in range(n)}
    up[60] = 999
    loop = {200: 201, 201: 202, 202: 200, 203: 200}
    rows = [("s", f"m{k}", None if p is None else f"m{p}") for k, p in {**up, **loop}.items()]
    r.shuffle(rows)
    got = {x["mid"]: x for x in conversations.resolve(spark.createDataFrame(rows, "session_id string, mid string, up string")).collect()}
    for k in range(n):
        assert (got[f"m{k}"]["depth"], got[f"m{k}"]["orphan"]) == ((k, False) if k < 60 else (k - 60, k == 60))
        assert got[f"m{k}"]["root"] == got["m0" if k < 60 else "m60"]["root"]
        assert not got[f"m{k}"]["cyclic"]
    assert all(got[f"m{k}"]["cyclic"] for k in loop)


# p7 ---------------------------------------------------------------------------------------------------------


def test_ids_equal_the_public_library(spark):
    tiktoken = pytest.importorskip("tiktoken")
    ranks = tokenize.parse_ranks(open(tokenize.VOCABULARY, "rb").read())
    public = tiktoken.Encoding("own", pat_str=tokenize.PATTERN, mergeable_ranks=ranks, special_tokens={})
    r = random.Random(1)
    alphabet = ["a", "b", "the", " ", "\n", "\t", "1", "é", "日本", "👍🏽", "'ll", "<|endoftext|>", " ", "­", "\\n", "_", "%"]
    texts = ["".join(r.choices(alphabet, k=r.randrange(60))) for _ in range(400)] + ["ab" * 4000, "", None, " ", "don't  stop\n\n"]
    got = {x["doc_id"]: x["ids"] for x in tokenize.encode_corpus(documents(spark, texts)).collect()}
    assert got == {k: public.encode_ordinary(t) if t else [] for k, t in enumerate(texts)}
    assert all(public.decode(got[k]) == (t or "") for k, t in enumerate(texts))
    assert tokenize.encode_corpus(documents(spark, [])).count() == 0


def test_segment_tree_names_the_leftmost_lowest():
    r = random.Random(2)
    keys = [r.randrange(50) * 100 + k for k in range(77)]
    tree = tokenize.PairTree(keys, 1 << 40)
    for _ in range(300):
        k = r.randrange(77)
        keys[k] = r.choice([1 << 40, r.randrange(50) * 100 + k])
        tree.put(k, keys[k])
        assert tree.root() == min(keys)


# p8 ---------------------------------------------------------------------------------------------------------


def items_of(seed, n):
    r = random.Random(seed)
    vocabulary = ["".join(r.choices("abcdefghijklmnop", k=r.randrange(3, 9))) for _ in range(900)]
    standing = "return the final answer as one fenced block and list every file that you changed below it"
    return [" ".join(r.choices(vocabulary, k=45)) + ". " + standing + "." for _ in range(n)], vocabulary, standing, r


def test_leaks(spark):
    texts, vocabulary, standing, r = items_of(3, 60)
    filler = lambda n: " ".join(r.choices(["alpha", "beta", "gamma", "delta"], k=n))
    words = [t.split() for t in texts]

    def changed(k, every):
        return [r.choice(vocabulary) if j % every == every - 1 else w for j, w in enumerate(words[k][:40])]

    docs = [
        filler(30) + " " + " ".join(words[0][5:30]) + " " + filler(20),  # a part
        " ".join(changed(1, 9)),  # one word in nine changed
        "<b>" + "</b> <i>".join(w.upper() for w in words[2][:30]) + "</i>",  # markup and case
        json.dumps({"prompt": "\n".join(words[3][:40])}),  # escapes
        "-\n".join([" ".join(words[4][:20])[:60], " ".join(words[4][:20])[60:] + " " + " ".join(words[4][20:35])]),  # hyphenation
        filler(10) + " ".join(words[5][:14]) + " " + filler(10),  # too short
        standing + ". " + filler(40),  # only what all share
        " ".join(changed(6, 2)),  # half of it changed
        None, "", "x" * 100_000,
    ]
    eval_items = spark.createDataFrame([(100 + k, t, "x") for k, t in enumerate(texts)] + [(1, None, "x"), (2, "", "x")], "item_id long, text string, doc_id string")
    want = {(0, 100), (1, 101), (2, 102), (3, 103), (4, 104)}
    assert {tuple(x) for x in leakage.leaks(documents(spark, docs), eval_items).collect()} == want
    assert {tuple(x) for x in leakage.leaks(documents(spark, docs), eval_items, block_chars=3000).collect()} == want
    assert leakage.leaks(documents(spark, []), eval_items).count() == 0
    assert leakage.leaks(documents(spark, docs), eval_items.limit(0)).count() == 0


def test_index_finds_every_shared_gram():
    texts, *_ = items_of(4, 12)
    items = list(enumerate(texts))
    budget = leakage.Budget()
    index = leakage.Index(items, leakage.Common(items, budget, 6, 0.05, 5), budget)
    import numpy as np

    text = "".join(leakage.words_of(texts[3])[:30])
    at, item, place = index.hits(leakage._grams(np.frombuffer(text.encode(), np.uint8)))
    assert len({a for a, i, p in zip(at, item, place) if i == 3 and a == p}) > 80


# p9 ---------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("form", ["{{ x }}", "{x}", "{0}", "${X}", "$X_Y$", "%s", "%(x)s", "@@x@@", "[[x]]", "<<x>>", "<% x %>", "{% x %}", "__X__", "#{x}", "<X_Y>", "<your x>", "[INSERT X]", "[x: TBD]", "[total x here]", "XXXX", "undefined", "[object Object]"])
def test_placeholder(form):
    assert residue.placeholder(f"The final score of {form} was high. More text follows here.")
    assert not residue.placeholder(f"The loader replaces `{form}` by the value.")
    assert not residue.placeholder(f"Use this:\n\n```\n{form}\n```\nIt works.")


def test_residue(spark):
    body = "The reviewer compared 89 retries and left the token count unchanged."
    yes = [
        "404 Not Found\nThe page you asked for is not on this server.", "Home | Search | Sign in\n\nPlease enable JavaScript to view this page.\n\nRequest id 9af3b21c.",
        "<html><head><title>X</title></head><body><p>We could not load the page.</p><hr>ab12cd34ef</body></html>", "Lorem ipsum dolum setur adipor. Inci magnor velis alqua nostra.",
        "bla " * 40, "Item 1\nBody text\nSection 2\nShort text", "Your text goes here.", "Bitte aktivieren Sie JavaScript, um fortzufahren.", body + " Total cost: {{ cost }}.", "Dear undefined, the run has finished.",
    ]
    no = [
        body, None, "", "​", "Our hook treats a page that says \"404 Not Found\" as an error instead of scoring it. " + body, "The agent met a `502 Bad Gateway` and passed. " + body,
        "a/b.py\nc/d.py", '{"score": 3, "judge": "x"}', "Der Lauf mit dem Modell brauchte 9 Schritte.", "評価者は 56 点を付けました。", (body + " ") * 2000,
    ]
    got = {r["doc_id"] for r in residue.residue(documents(spark, yes + no)).collect()}
    assert got == set(range(len(yes)))
    assert residue.residue(documents(spark, [])).count() == 0


def test_recurring_lines_are_subtracted(spark):
    page = "Sorry, we failed to show this view.\nWrite to the desk of the night harness for help with it."
    texts = [f"Report {k} of the night was archived in time.\nWrite to the desk of the night harness for help with it." for k in range(8)] + [page]
    assert [r["doc_id"] for r in residue.residue(documents(spark, texts)).collect()] == [8]
    assert residue.residue(documents(spark, [page])).count() == 0


def test_notices_without_common_words(spark):
    lines = ["400 Bad Request", "401 Unauthorized", "408 Request Timeout", "410 Gone", "422 Unprocessable Entity", "Page  not\xa0 found", "Access\xa0denied", "JS  is off"]
    assert [residue.kinds([x])[0] for x in lines] == ["error"] * 7 + ["script"] and residue.kinds(["NA"]) == ["filler"]
    texts = ["400 Bad Request", "NA", "Home | Sign in\n\nVelits morbe dolum kelor nisu magnor.", "The reviewer compared 89 retries and left the token count unchanged."]
    assert {r["doc_id"] for r in residue.residue(documents(spark, texts)).collect()} == {0, 1, 2}


def test_long_furniture_is_subtracted_too(spark):
    menu = "\n".join(f"Read what the desk number {word} of the archive wrote about the harness." for word in "one two three four five six seven eight nine ten red blue green grey".split())
    texts = [f"Report {k} of the night was archived in time.\n{menu}" for k in range(8)] + ["404 Not Found\n" + menu]
    assert [r["doc_id"] for r in residue.residue(documents(spark, texts)).collect()] == [8]


def test_one_very_long_line_recurs(spark):
    notice = "We and our partners keep what you read here for the reports of the archive, count the pages that are opened by each guest, compare them with those of the week before, and send a summary of all this to the owner of the harness, unless you refuse that at the desk."
    texts = [f"Report {k} of the night was archived in time.\n{notice}" for k in range(8)] + ["404 Not Found\n" + notice, "404 Not Found\n" + notice.replace("desk", "door")]
    assert [r["doc_id"] for r in residue.residue(documents(spark, texts)).collect()] == [8]


def test_baseline_is_the_source_s_own(spark):
    count = [("d", "small", "f nightly harness", 100), ("d", "small", "f other", 4900), ("d", "large", "f best wishes", 20_000), ("d", "large", "f other", 980_000), ("d", "tiny", "f other", 50)]
    rows = [("count", t, s, None, None, k, n) for t, s, k, n in count]
    asked = [("small", "f nightly harness"), ("large", "f nightly harness"), ("small", "f best wishes"), ("large", "f best wishes"), ("tiny", "f best wishes"), ("tiny", "f nightly harness")]
    rows += [("ask", "d", s, n, "text", k, 1) for n, (s, k) in enumerate(asked)]
    probed = spark.createDataFrame(rows, truncation._SCHEMA)
    assert sorted(r["row_id"] for r in truncation.cut_values(probed).collect()) == [1, 2, 5]
