"""Jaccard join, suffix dedup and decontamination against brute force, on small and odd tables."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tallyworks.llm import jaccard_join
from tallyworks.llm.decontaminate import LOWER, UPPER, Settings, contamination, without_contaminated
from tallyworks.llm.graph import components
from tallyworks.llm.jaccard_join import CHUNKS, JoinSettings, _meet, _merge, _profile, jaccard_components, one_of_each_group
from tallyworks.llm.suffix_dedup import SuffixSettings, cut_words, repeated_passages, without_repeats
from tallyworks.llm.words import run_hashes, word_hashes

SMALL = JoinSettings(sketch_bits=12, wanted_bits=10)
ODD = "doc_id long, text string, lang string, component_id int, sig string, n int"


def texts(seed=5, groups=12):
    """Random texts, edited copies of some, a cloud of 60 copies of one, and odd rows."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    rows = []
    for _ in range(groups):
        base = [word() for _ in range(rng.randint(8, 60))]
        for _ in range(rng.randint(1, 5)):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = word()
            rows.append(" ".join(copy))
    base = [word() for _ in range(80)]
    for i in range(60):
        copy = list(base)
        for _ in range(i % 5):
            copy[rng.randrange(80)] = word()
        rows.append(" ".join(copy))
    rows += [None, "", "  \t\n ", "one", "ONE", "one two", "One\vtwo", "é É", "é é"]
    rows.append("long " * 3000 + "tail")
    ids = list(range(len(rows)))
    rng.shuffle(ids)
    return list(zip(ids, rows))


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def groups_of(rows):
    sets = {}
    for i, text in rows:
        sets.setdefault(i, []).append(shingles(text))
    name = {i: i for i in sets}

    def find(x):
        while name[x] != x:
            x = name[x]
        return x

    flat = [(i, s) for i, many in sets.items() for s in many if s]
    for k, (i, a) in enumerate(flat):
        for j, b in flat[:k]:
            if 100 * len(a & b) >= 75 * len(a | b) and find(i) != find(j):
                name[max(find(i), find(j))] = min(find(i), find(j))
    return {i: find(i) for i in sets}


def odd_frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", 7, "x", 3) for i, t in rows], ODD).repartition(3)


def test_components_of_chain_star_and_pairs(spark):
    links = [(i, i + 1) for i in range(100, 140)] + [(7, i) for i in range(20, 60)] + [(3, 2), (2, 3), (5, 5), (None, 4)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = {i: 100 for i in range(100, 141)} | {i: 7 for i in [7, *range(20, 60)]} | {2: 2, 3: 2}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_jaccard_components_match_brute_force(spark):
    rows = texts()
    got = jaccard_components(odd_frame(spark, rows), SMALL).collect()
    want = groups_of(rows)
    assert len(got) == len(rows)
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    sizes = {i: len(shingles(t)) for i, t in rows}
    assert {r["doc_id"]: r["n_shingles"] for r in got} == sizes


def test_jaccard_long_lists_of_rare_tokens(spark):
    """A sketch too small to tell any token from another: all are rare, and the cloud's lists are long."""
    rows = texts(seed=8)
    settings = JoinSettings(sketch_bits=5, wanted_bits=10, longest=4)
    got = jaccard_components(odd_frame(spark, rows), settings).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == groups_of(rows)


def test_sketch_counts_beyond_a_byte_and_lists_stay_linear():
    same = "one two three four five"
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(1000)), "text": [f"{same} w{i}".encode() for i in range(1000)]})
    parts = [b.select(["chunk", "counts"]) for b in _profile(SMALL)(iter([batch])) if b["chunk"].null_count == 0]
    levels = {b["chunk"][0].as_py(): b["levels"][0].as_py() for b in _merge(600)(iter(parts))}
    slot = int(run_hashes(word_hashes(same.encode()), 5)[0] >> np.uint64(64 - SMALL.sketch_bits))
    size = (1 << SMALL.sketch_bits) // CHUNKS
    assert levels[slot // size][slot % size] > 0
    key = (np.full(5000, 77, np.int64) << 17) | (100 << 7)
    met = list(_meet(SMALL)(iter([pa.RecordBatch.from_pydict({"key": key, "sig": np.arange(5000)})])))
    assert sum(b.num_rows for b in met) == 4999
    assert {(k, a) for b in met for k, a in zip(b["kind"].to_pylist(), b["a"].to_pylist())} == {(1, 0)}


def test_sketch_knows_a_frequent_token_among_many_rare_ones():
    """Ten times as many tokens as the sketch has entries: only what is frequent is in it."""
    same = "one two three four five"
    texts = [" ".join([same, *(f"w{i}_{k}" for k in range(400))]).encode() for i in range(100)]
    batches = [pa.RecordBatch.from_pydict({"doc_id": [i], "text": [text]}) for i, text in enumerate(texts)]
    found = {chunk: blob for chunk, blob in _levels(batches)}
    slot = int(run_hashes(word_hashes(same.encode()), 5)[0] >> np.uint64(64 - SMALL.sketch_bits))
    size = (1 << SMALL.sketch_bits) // CHUNKS
    assert found[slot // size][slot % size] > 0
    assert sum(np.count_nonzero(np.frombuffer(blob, np.uint8)) for blob in found.values()) <= 5


def _levels(batches):
    """Profiles of several tasks, merged as Spark sorts them."""
    parts = [b.select(["chunk", "counts"]) for k in range(3) for b in _profile(SMALL)(iter(batches[k::3])) if not b["chunk"].null_count]
    rows = pa.Table.from_batches(parts).sort_by([("chunk", "ascending"), ("counts", "ascending")])
    for b in _merge(8)(iter(rows.to_batches(max_chunksize=7))):
        yield b["chunk"][0].as_py(), b["levels"][0].as_py()


def test_jaccard_repeated_and_null_ids(spark):
    a, b = "a b c d e f g h i j", "k l m n o p q r s t"
    rows = [(4, a), (4, b), (9, a), (2, b), (None, a), (None, None), (11, "z"), (11, "z")]
    frame = odd_frame(spark, rows)
    got = sorted(((r["doc_id"], r["component_id"]) for r in jaccard_components(frame, SMALL).collect()), key=str)
    assert got == sorted([(4, 2), (4, 2), (9, 2), (2, 2), (None, None), (None, None), (11, 11), (11, 11)], key=str)
    kept = one_of_each_group(frame, SMALL)
    assert kept.columns == frame.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted([2, 11, None, None], key=str)


@pytest.mark.parametrize("most", [jaccard_join.KNOWN_IDS, 0])
def test_one_of_each_group_moves_no_texts(spark, monkeypatch, most):
    """Where Spark broadcasts nothing by itself; beyond the bound the rows are the same."""
    monkeypatch.setattr(jaccard_join, "KNOWN_IDS", most)
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    try:
        a, b = "a b c d e f g h i j", "k l m n o p q r s t"
        rows = [(4, a), (9, a), (4, b), (2, b), (None, a), (11, "z"), (11, "z"), (12, "y")]
        kept = one_of_each_group(odd_frame(spark, rows), SMALL)
        plan = kept._jdf.queryExecution().executedPlan().toString()
        assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted([2, 11, 12, None], key=str)
    finally:
        spark.conf.set(name, before)
    assert ("SortMergeJoin" in plan) == (most == 0)


def test_jaccard_empty_table(spark):
    assert jaccard_components(odd_frame(spark, []), SMALL).count() == 0


def passages(seed=3):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    shared = [[word() for _ in range(n)] for n in (50, 63, 120, 49)]
    rows = []
    for i in range(40):
        parts = [[word() for _ in range(rng.randint(0, 80))]]
        for _ in range(rng.randint(0, 2)):
            parts += [rng.choice(shared), [word() for _ in range(rng.randint(1, 30))]]
        rows.append((i, " ".join(w for p in parts for w in p)))
    return [*rows, (40, None), (41, ""), (42, rows[3][1]), (43, "w " * 400), (44, "w " * 60)]


def windows(rows, size):
    seen, words = {}, {}
    for i, t in rows:
        w = tuple((t or "").encode().lower().split())
        words[i] = w
        for k in range(len(w) - size + 1):
            seen.setdefault(w[k : k + size], set()).add(i)
    every, later = {}, {}
    for i, w in words.items():
        for k in range(len(w) - size + 1):
            owners = seen[w[k : k + size]]
            if len(owners) > 1:
                every.setdefault(i, set()).update(range(k, k + size))
                if min(owners) < i:
                    later.setdefault(i, set()).update(range(k, k + size))
    return every, later, words


def test_repeated_passages_match_brute_force(spark):
    rows = passages()
    frame = odd_frame(spark, rows)
    settings = SuffixSettings(filter_bits=16)
    every, later, words = windows(rows, 50)
    got, cut = {}, {}
    for r in repeated_passages(frame, settings).collect():
        got.setdefault(r["doc_id"], set()).update(range(r["start_word"], r["stop_word"]))
        for c in r["cut"]:
            cut.setdefault(r["doc_id"], set()).update(range(c["start"], c["stop"]))
    assert got == every
    assert cut == later
    left = without_repeats(frame, settings)
    assert left.columns == frame.columns
    for r in left.collect():
        if r["doc_id"] == 40:
            assert r["text"] is None
        else:
            kept = [w for k, w in enumerate(words[r["doc_id"]]) if k not in later.get(r["doc_id"], ())]
            assert r["text"].encode().lower().split() == kept


def test_passages_of_many_sharers_match_brute_force(spark):
    """200 documents share a passage, another a tail, each with its own words around it, ids in no order."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    own = lambda: [word() for _ in range(rng.randint(20, 60))]
    middle, tail, few = ([word() for _ in range(n)] for n in (55, 130, 70))
    rows = []
    for i in range(600):
        if i < 200:
            cut = rng.randint(0, 5)
            parts = [own(), middle[cut : cut + 50], own()]
        elif i < 400:
            parts = [own(), tail[rng.randint(0, 80) :]]
        else:
            parts = [own(), few[i % 20 :], own()] if i % 25 == 0 else [own(), own()]
        rows.append((i, " ".join(w for p in parts for w in p)))
    ids = [i for i, _ in rows]
    rng.shuffle(ids)
    rows = [(i, text) for i, (_, text) in zip(ids, rows)]
    every, later, words = windows(rows, 50)
    least = {}
    for i, w in words.items():
        for k in range(len(w) - 49):
            least[w[k : k + 50]] = min(i, least.get(w[k : k + 50], i))
    got, cut = {}, {}
    for r in repeated_passages(odd_frame(spark, rows), SuffixSettings(filter_bits=16)).collect():
        i, start, stop = r["doc_id"], r["start_word"], r["stop_word"]
        got.setdefault(i, set()).update(range(start, stop))
        assert r["first_doc_id"] == min(least[words[i][k : k + 50]] for k in range(start, stop - 49))
        for c in r["cut"]:
            cut.setdefault(i, set()).update(range(c["start"], c["stop"]))
    assert got == every
    assert cut == later


def test_repeated_passages_empty_and_same_id(spark):
    settings = SuffixSettings(filter_bits=16)
    assert repeated_passages(odd_frame(spark, []), settings).count() == 0
    text = " ".join(f"w{i}" for i in range(70))
    assert repeated_passages(odd_frame(spark, [(1, text), (1, text), (None, text)]), settings).count() == 0
    got = repeated_passages(odd_frame(spark, [(1, text), (1, text), (2, text)]), settings).collect()
    assert {(r["doc_id"], r["start_word"], r["stop_word"], r["first_doc_id"]) for r in got} == {(1, 0, 70, 1), (2, 0, 70, 1)}


def test_cut_words():
    assert cut_words(b" a b  c\nd e", [(1, 3)]) == b" a d e"
    assert cut_words(b"a b", [(0, 2)]) == b""
    assert cut_words(b"a b c d", [(2, 4), (1, 3)]) == b"a "


BENCH = "item_id long, text string, doc_id string"
ITEM = "zero one two three four five six seven eight nine ten eleven"


def brute_contamination(rows, items, size=10):
    pattern, low = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), str.maketrans(UPPER, LOWER)
    split = lambda t: pattern.findall((t or "").translate(low))
    known = {}
    for item, t in items:
        w = split(t)
        k = min(size, len(w))
        for j in range(len(w) - k + 1 if w else 0):
            known.setdefault(tuple(w[j : j + k]), set()).add(str(item))
    out = []
    for i, t in rows:
        w, hit, found = split(t), set(), set()
        for gram, owners in known.items():
            for j in range(len(w) - len(gram) + 1):
                if tuple(w[j : j + len(gram)]) == gram:
                    hit.update(range(j, j + len(gram)))
                    found |= owners
        out.append((i, len(w), len(hit), len(found), bool(hit)))
    return sorted(out, key=str)


@pytest.mark.parametrize("limit", [500_000, 0])
def test_contamination_matches_brute_force(spark, limit):
    items = [(1, ITEM), (2, "Short one!"), (3, None), (4, ""), (5, ITEM), (12, "é")]
    rows = [
        (1, f"before {ITEM.upper()}, after"), (2, "zero-one two;three four five six seven eight"), (3, "a short ONE here short one"),
        (4, None), (5, ""), (6, "nothing"), (6, "é!"), (None, ITEM + " " + ITEM), (7, "x " * 5000 + ITEM), (8, "É"),
    ]
    frame = odd_frame(spark, rows)
    bench = spark.createDataFrame([(i, t, "clash") for i, t in items], BENCH)
    settings = Settings(broadcast_windows=limit)
    got = contamination(frame, bench, settings).collect()
    want = brute_contamination(rows, items)
    assert sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) for r in got), key=str) == want
    clean = without_contaminated(frame, bench, settings)
    assert clean.columns == frame.columns
    texts = {t for (i, t) in rows}
    hit = {t for i, t in rows if brute_contamination([(i, t)], items)[0][4]}
    assert {r["text"] for r in clean.collect()} == texts - hit


def test_contamination_without_windows(spark):
    bench = spark.createDataFrame([(1, None)], "item_id long, text string")
    frame = odd_frame(spark, [(1, "a b")])
    assert [(r["n_words"], r["n_hit"], r["contaminated"]) for r in contamination(frame, bench).collect()] == [(2, 0, False)]
    assert without_contaminated(frame, bench).count() == 1
    assert contamination(odd_frame(spark, []), bench).count() == 0
