"""Near-duplicates, substring dedup and components against brute force, on hot, empty, null and repeated rows."""

import random
from difflib import SequenceMatcher

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from stylograph.llm import passages, simhash
from stylograph.llm.common import Scratch, components, forest

SCHEMA = "doc_id long, text string, lang string"


def brute_fingerprint(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").split(" ") if w]
    parts = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    out = [(k, text(rng.randint(1, 120)), "en") for k in range(120)]
    base = text(150).split()
    for k in range(60):  # a large group of near copies
        w = list(base)
        w[rng.randrange(150)] = "changed"
        out.append((200 + k, " ".join(w), "en"))
    out += [(300 + k, "copy of one text that is always the same, word by word", "fr") for k in range(40)]
    out += [(400, None, None), (401, "", ""), (402, " \n\t", None), (403, "É Ü ABC abc", None), (403, "É Ü ABC abc", None), (404, text(30_000), "en")]
    return out


@pytest.mark.parametrize("kw", [{}, {"tile": 8, "local_edges": 4}])
def test_simhash(spark, rows, kw):
    got = {}
    for r in simhash.simhash(spark.createDataFrame(rows, SCHEMA), Scratch(spark, "t"), **kw).collect():
        got.setdefault(r["doc_id"], []).append((r["fp"] % (1 << 64), r["component_id"]))
    want = {d: brute_fingerprint(t) for d, t, _ in rows}
    up = forest((a, b) for a in want for b in want if bin(want[a] ^ want[b]).count("1") <= 4)
    assert {d: v[0] for d, v in got.items()} == {d: (want[d], up[d]) for d in want}
    assert len(got[403]) == 2 and len(set(got[403])) == 1


def test_simhash_blocks_find_every_link():
    rng = np.random.default_rng(1)
    fp = rng.integers(0, 1 << 63, 300, np.uint64)
    near = fp.copy()
    for i in range(len(near)):
        for b in rng.choice(64, 4, replace=False):
            near[i] ^= np.uint64(1) << np.uint64(b)
    for blocks in (5, 6, 7):
        edges = [round(k * 64 / blocks) for k in range(blocks + 1)]
        same = np.stack([(fp >> np.uint64(a) ^ near >> np.uint64(a)) & np.uint64((1 << (b - a)) - 1) == 0 for a, b in zip(edges, edges[1:], strict=False)])
        assert (same.sum(0) >= blocks - 4).all()


def test_simhash_null_id_and_empty_table(spark):
    d = spark.createDataFrame([(None, "x y z w"), (5, "x y z w"), (None, "another")], "doc_id long, text string")
    r = sorted((str(x["doc_id"]), str(x["component_id"])) for x in simhash.simhash(d, Scratch(spark, "t")).collect())
    assert r == [("5", "5"), ("None", "5"), ("None", "None")]
    assert simhash.simhash(d.filter("false"), Scratch(spark, "t")).count() == 0


def test_simhash_rows_without_id_connect(spark):
    """Brute force over texts some of which have no doc_id, or one that other texts have too."""
    rng = random.Random(6)
    base = [f"w{k}" for k in range(90)]
    rows, words = [], list(base)
    for k in range(120):  # a chain of near copies: each changes a word of the one before
        words = list(words)
        words[rng.randrange(90)] = f"x{k}"
        rows.append((None if k % 3 else k // 6, " ".join(words), "en"))
    got = simhash.simhash(spark.createDataFrame(rows, SCHEMA), Scratch(spark, "t")).collect()
    prints = [brute_fingerprint(t) for _, t, _ in rows]
    up = forest((min(a, b), max(a, b)) for a in set(prints) for b in set(prints) if bin(a ^ b).count("1") <= 4)
    least = {}
    for (d, _, _), f in zip(rows, prints, strict=True):
        c = up.get(f, f)
        least[c] = min((x for x in (least.get(c), d) if x is not None), default=None)
    want = sorted(((d, f, least[up.get(f, f)]) for (d, _, _), f in zip(rows, prints, strict=True)), key=str)
    assert sorted(((r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in got), key=str) == want
    with_ids = forest((min(a, b), max(a, b)) for a in {f for (d, _, _), f in zip(rows, prints, strict=True) if d is not None} for b in {f for (d, _, _), f in zip(rows, prints, strict=True) if d is not None} if bin(a ^ b).count("1") <= 4)
    assert len(set(up.values())) < len(set(prints)) and any(up[a] == up[b] and with_ids.get(a) != with_ids.get(b) for a in with_ids for b in with_ids)  # rows without id bridge others


@pytest.mark.parametrize("local_edges", [1_000_000, 3])
def test_components_of_hard_shapes(spark, local_edges):
    chain = [(k, k + 1) for k in range(60)]
    star = [(100, 100 + k) for k in range(1, 60)]
    ring = [(200 + k, 200 + (k + 1) % 30) for k in range(30)]
    edges = spark.createDataFrame([*chain, *star, *ring, *star, (500, 500), (None, 3)], "a long, b long")
    got = {r["node"]: r["component"] for r in components(edges, Scratch(spark, "t"), local_edges).collect()}
    assert got == forest([*chain, *star, *ring])


@pytest.fixture(scope="module")
def passage_rows():
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("klmnopqr") for _ in range(rng.randint(2, 7))) for _ in range(500)]
    line = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    shared = [line(60) for _ in range(3)]
    out = []
    for k in range(80):
        parts = [line(rng.randint(3, 40)) for _ in range(4)]
        if k % 2:
            w = shared[k % 3].split()
            if k % 5 == 0:
                w[rng.randrange(60)] = "odd"
            parts.insert(rng.randrange(4), " ".join(w))
        out.append((k, "\n".join(parts), "en"))
    return [*out, (90, None, None), (91, "", None), (92, "\n\n", None), (93, shared[0] + "\n" + shared[0], None), (94, line(20_000), None)]


@pytest.mark.parametrize("kw", [{}, {"tile": 4, "local_edges": 3}])
def test_passages(spark, passage_rows, kw):
    seen = [(d, a, b, frozenset(passages.shingles(x))) for d, t, _ in passage_rows for a, b, x in passages.paragraphs(t or "", 20)]
    similar = lambda x, y: len(x & y) >= 0.8 * len(x | y)
    up = forest((i, j) for i in range(len(seen)) for j in range(i + 1) if similar(seen[i][3], seen[j][3]))
    first = {}
    for i in sorted(range(len(seen)), key=lambda i: seen[i][:2]):
        first.setdefault(up[i], i)
    want = sorted((d, a, b, seen[first[up[i]]][0]) for i, (d, a, b, _) in enumerate(seen) if first[up[i]] != i)
    docs = spark.createDataFrame(passage_rows, SCHEMA)
    found = passages.repeats(docs, Scratch(spark, "t"), inner=False, **kw)
    assert sorted((r["doc_id"], r["start"], r["end"], r["kept_doc_id"]) for r in found.collect()) == want
    cut = {r["doc_id"]: r["text"] for r in passages.without(docs, found).collect()}
    texts = {d: t for d, t, _ in passage_rows}
    assert cut[93] == "" or cut[93] == texts[93].split("\n")[0] + "\n"
    assert cut[90] is None and all(cut[k] == texts[k] for k in texts if k not in {w[0] for w in want})


def test_passages_inside_lines(spark):
    rng = random.Random(9)
    vocabulary = ["".join(rng.choice("stuvwxyz") for _ in range(rng.randint(2, 7))) for _ in range(800)]
    line = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage, rows = "é " + line(58) + " ß", []
    for k in range(60):
        text = line(rng.randint(30, 90))
        rows.append((k, f"{text} {passage} {line(40)}\n{line(15)}" if k % 2 else text, None))
    rows += [(100, None, None), (101, "", None), (102, "a a a a " * 3000, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    found = passages.repeats(docs, Scratch(spark, "t"))
    got = {r["doc_id"]: r for r in found.collect()}
    assert set(got) == set(range(3, 60, 2)) and all(r["inner"] and r["kept_doc_id"] == 1 for r in got.values())
    for r in got.values():  # within the passage, and most of it
        piece = rows[r["doc_id"]][1][r["start"] : r["end"]]
        assert piece in passage and len(piece) > 0.5 * len(passage)
    cut = {r["doc_id"]: r["text"] for r in passages.without(docs, found).collect()}
    assert all(cut[k] == rows[k][1][: got[k]["start"]] + rows[k][1][got[k]["end"] :] for k in got) and cut[1] == rows[1][1]


def test_passages_of_an_empty_table(spark):
    assert passages.repeats(spark.createDataFrame([], SCHEMA), Scratch(spark, "t")).count() == 0


def test_bands_reach_their_recall():
    bands, rows = passages.tune(0.8, 0.995, 64)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.995 and bands * rows <= 64


def test_extra_columns_of_clashing_names(spark, rows):
    d = spark.createDataFrame(rows[:5], SCHEMA).withColumns({c: F.lit("x") for c in ("fp", "rep", "component", "node", "start")})
    assert simhash.simhash(d, Scratch(spark, "t")).count() == 5 and passages.repeats(d, Scratch(spark, "t")).count() == 0


def _planted(rng, lengths):
    """Documents of words that occur once, and passages of these lengths at one random place in two of them each."""
    fresh = iter(range(10**9))
    prose = lambda n: [f"w{next(fresh)}" for _ in range(n)]
    rows, want = [], {}
    for k, n in enumerate(lengths):
        passage = prose(n)
        for d in (2 * k, 2 * k + 1):
            before = prose(rng.randint(0, 40))
            rows.append((d, " ".join([*before, *passage, *prose(rng.randint(0, 40))]), None))
            start = len(" ".join(before)) + bool(before)
            want[d] = (start, start + len(" ".join(passage)), n)
    return rows, {d: (*v, d - 1, want[d - 1][0]) for d, v in want.items() if d % 2}


def test_passages_inside_lines_are_found_whole(spark):
    rows, want = _planted(random.Random(21), [n for n in range(20, 80) for _ in range(3)])
    found = passages.inner_repeats(spark.createDataFrame(rows, SCHEMA), Scratch(spark, "t")).collect()
    assert sorted((r["doc_id"], r["start"], r["end"], r["n_words"], r["kept_doc_id"], r["kept_start"]) for r in found) == sorted((d, *v) for d, v in want.items())


def test_no_window_that_occurs_earlier_stays(spark):
    rng = random.Random(23)
    pool = [[f"v{rng.randrange(60)}" for _ in range(rng.randint(5, 70))] for _ in range(30)]
    split = [[w for _ in range(rng.randint(1, 6)) for w in rng.choice(pool)[rng.randint(0, 4) :]] for _ in range(120)]
    docs = spark.createDataFrame([(d, " ".join(w), None) for d, w in enumerate(split)], SCHEMA)
    gone = {d: set() for d in range(len(split))}
    for r in passages.inner_repeats(docs, Scratch(spark, "t")).collect():
        text, kept = " ".join(split[r["doc_id"]]), " ".join(split[r["kept_doc_id"]])
        piece = text[r["start"] : r["end"]]
        w, other = piece.split(), kept[r["kept_start"] :].split()
        equal = sum(x.size for x in SequenceMatcher(None, w, other[: len(w) + 2 * passages.BRIDGE], False).get_matching_blocks())
        assert equal >= 0.8 * len(w) and w[:20] == other[:20] and len(w) == r["n_words"]
        at = text[: r["start"]].count(" ")
        gone[r["doc_id"]] |= set(range(at, at + r["n_words"]))
    first: dict = {}
    for d, w in enumerate(split):
        for i in range(len(w) - 19):
            kept_doc, kept = first.setdefault(tuple(w[i : i + 20]), (d, i))
            if kept_doc != d or i - kept >= 20:
                assert len(gone[d] & set(range(i, i + 20))) > 20 - passages.EDGE


def test_only_what_stands_together_elsewhere_goes(spark):
    words = [f"u{k}" for k in range(2000)]
    pieces = [words[10 * k : 10 * k + 10] for k in range(30)]
    rows = [(k, " ".join([*words[1000 + 10 * k : 1010 + 10 * k], *p, *words[1500 + 10 * k : 1510 + 10 * k]]), None) for k, p in enumerate(pieces)]
    rows.append((50, " ".join(w for p in pieces for w in p), None))  # each piece occurs, no two of them together
    near = [f"n{k}" for k in range(60)]
    rows += [(60, " ".join(near), None), (61, " ".join([*near[:25], "other", *near[26:]]), None), (62, " ".join([*near[:25], *(f"x{k}" for k in range(30)), *near[26:]]), None)]
    got = sorted((r["doc_id"], r["n_words"], r["kept_doc_id"], r["start"]) for r in passages.inner_repeats(spark.createDataFrame(rows, SCHEMA), Scratch(spark, "t")).collect())
    assert got == [(61, 60, 60, 0), (62, 25, 60, 0), (62, 34, 60, len(" ".join([*near[:25], *(f"x{k}" for k in range(30))])) + 1)]


def test_the_last_copy_of_a_passage_stays(spark):
    words = [f"p{k}" for k in range(600)]
    b = [f"b{k}" for k in range(60)]
    near = [*words[:200], *b, *words[260:]]
    rows = [(1, " ".join(words), None), (2, " ".join(near), None), (3, " ".join(["x1", "x2", *b, "y1", "y2"]), None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    cut = {r["doc_id"]: r["text"] for r in passages.without(docs, passages.repeats(docs, Scratch(spark, "t"))).collect()}
    assert cut == {1: rows[0][1], 2: "", 3: rows[2][1]}


def test_rows_of_one_doc_id_or_none_are_told_apart(spark):
    line = lambda c, n=30: " ".join(f"{c}{k}" for k in range(n))
    rows = [(4, line("a"), None), (5, line("a"), None), (5, line("c"), None), (None, line("d"), None), (None, line("e") + "\n" + line("a"), None), (None, None, None), (None, line("d") + " " + line("g"), None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    found = passages.repeats(docs, Scratch(spark, "t"))
    cut = sorted(((r["doc_id"] or 0, r["text"] or "") for r in passages.without(docs, found).collect()))
    # null doc_ids come first: theirs are the places that stay
    assert (5, line("c")) in cut and (4, "") in cut and (5, "") in cut and (0, line("e") + "\n" + line("a")) in cut and (0, "") in cut
    texts = [t for _, t in cut]
    assert sum(line("d") in t for t in texts) == 1 and sum(line("g") in t for t in texts) == 1


def test_common_seeds_give_the_same(spark):
    rng = random.Random(33)
    words = [f"z{k}" for k in range(300)]
    passage = [f"q{k}" for k in range(45)]
    rows = [(d, " ".join([*(rng.choice(words) for _ in range(rng.randint(0, 30))), *passage[rng.randint(0, 9) :], *(rng.choice(words) for _ in range(rng.randint(0, 30)))]), None) for d in range(80)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = [sorted(tuple(r) for r in passages.inner_repeats(docs, Scratch(spark, "t"), hot=n).select("doc_id", "start", "end", "n_words", "kept_doc_id", "kept_start").collect()) for n in (4096, 3)]
    assert got[0] == got[1] and len({r[0] for r in got[0]}) > 70


def test_every_removed_word_has_a_place_before_it(spark):
    """Brute force over both parts: what stays holds each window of 20 words of every text that isn't a near copy of what stays."""
    rng = random.Random(35)
    pool = [" ".join(f"v{rng.randrange(400)}" for _ in range(rng.randint(20, 50))) for _ in range(25)]
    near = lambda x: " ".join(f"n{rng.randrange(10**6)}" if rng.random() < 0.02 else w for w in x.split())
    rows = []
    for d in range(60):
        parts = [rng.choice(pool) if rng.random() < 0.6 else near(rng.choice(pool)) for _ in range(rng.randint(1, 3))]
        rows.append((d, rng.choice(["\n", " "]).join(parts), None))
    docs = spark.createDataFrame(rows, SCHEMA)
    found = passages.repeats(docs, Scratch(spark, "t")).collect()
    cut = {r["doc_id"]: r["text"] for r in passages.without(docs, spark.createDataFrame(found)).collect()}
    left = {w for t in cut.values() for w in t.split()}
    # words of the pool are common to near copies; all of them stay somewhere
    assert {w for p in pool for w in p.split() if any(p in t for _, t, _ in rows)} <= left
    assert sum(len(t.split()) for t in cut.values()) < 0.7 * sum(len(t.split()) for _, t, _ in rows)
    order = {d: k for k, (d, _, _) in enumerate(rows)}
    assert all(order[r["kept_doc_id"]] < order[r["doc_id"]] or (r["kept_doc_id"] == r["doc_id"] and r["kept_start"] < r["start"]) for r in found)
