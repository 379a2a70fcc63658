"""Digest index, ranked search and prefix tries against brute force, on small and odd tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pyarrow as pa
import pytest

from tallyworks.llm import prefix_trie
from tallyworks.llm.exact_dedup import DigestIndex, buckets_for, load_documents, new_documents
from tallyworks.llm.lexical_search import SearchSettings, rank_documents, text_terms
from tallyworks.llm.prefix_trie import DoubleArray, TrieSettings, conversation_trie, trie_nodes, turn_sequences, with_openings

DOCS = "doc_id long, text string, digest string, id int, kept boolean, keep_id string, row string"


def docs_of(spark, rows):
    """With further columns whose names the operator uses itself."""
    return spark.createDataFrame([(i, t, f"own {n}", n, True, "x", "y") for n, (i, t) in enumerate(rows)], DOCS)


ROWS = [(1, "a"), (2, "b"), (3, "a"), (5, "A"), (4, "a "), (9, None), (8, ""), (7, "a"), (None, "c"), (6, "é" * 100_000), (10, "é" * 100_000)]


def decisions(rows, known=()):
    """Decisions about a load by plain Python; ``known`` are texts with the documents they were kept for."""
    groups, known = defaultdict(list), dict(known)
    for doc_id, text in rows:
        groups[text or ""].append(doc_id)
    out = []
    for text, ids in groups.items():
        keep = known.get(text, max((i for i in ids if i is not None), default=None))
        left = text not in known
        for doc_id in ids:
            kept = left and doc_id == keep
            left = left and not kept
            out.append((doc_id, keep, len(ids), kept, hashlib.sha256(text.encode()).hexdigest()))
    return out


def as_rows(frame, *names):
    return sorted((tuple(r[n] for n in names) for r in frame.collect()), key=repr)


DECIDED = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def test_first_load(spark, tmp_path):
    rows = ROWS + [(20, f"text {i % 3}") for i in range(40)] + [(21, "same")] * 5  # repeated ids, and repeated rows
    got = load_documents(docs_of(spark, rows), "one", path=str(tmp_path / "index"))
    assert as_rows(got, *DECIDED) == sorted(decisions(rows), key=repr)


def test_later_loads_only_add_what_is_new(spark, tmp_path):
    index = DigestIndex.open(spark, str(tmp_path / "index"), 4)
    second = [(100, "a"), (101, "new"), (99, "new"), (102, "b"), (103, None), (None, "other")]
    load_documents(docs_of(spark, ROWS), "one", index)
    known = {t or "": k for (_, t), (_, k, *_) in zip(ROWS, [next(d for d in decisions(ROWS) if d[4] == hashlib.sha256((t or "").encode()).hexdigest()) for _, t in ROWS])}
    for _ in range(2):  # a load that is tried again decides as before and adds nothing
        got = load_documents(docs_of(spark, second), "two", index)
        assert as_rows(got, *DECIDED) == sorted(decisions(second, known), key=repr)
        assert index.table().count() == len({t or "" for _, t in ROWS + second})
    again = DigestIndex.open(spark, str(tmp_path / "index"), 4)  # the files are the index
    assert not load_documents(docs_of(spark, ROWS + second), "three", again).where("kept").count()
    wider = again.rebuild(str(tmp_path / "wider"), 8)
    assert (wider.buckets, wider.table().count()) == (8, again.table().count())
    assert not load_documents(docs_of(spark, second), "four", wider).where("kept").count()
    wider.close()


def test_a_load_that_died_half_way_is_finished(spark, tmp_path):
    index = DigestIndex.open(spark, str(tmp_path / "index"), 4)
    half = spark.createDataFrame([(bytearray(hashlib.sha256(b"a").digest()), 7)], "digest binary, keep_id long")
    index.append(half, "one")
    got = load_documents(docs_of(spark, ROWS), "one", index)
    assert as_rows(got, *DECIDED) == sorted(decisions(ROWS), key=repr)


def test_kept_rows_have_all_their_columns(spark, tmp_path):
    index = DigestIndex.open(spark, str(tmp_path / "index"), 4)
    rows = ROWS + [(21, "same")] * 3
    frame = docs_of(spark, rows)
    got = new_documents(frame, "one", index)
    assert got.columns == frame.columns
    kept = [(i, t) for i, t in rows if (i, t or "") in {(d[0], t2 or "") for d in decisions(rows) if d[3] for t2 in [t] if d[4] == hashlib.sha256((t or "").encode()).hexdigest()}]
    assert as_rows(got, "doc_id", "text") == sorted(set(kept), key=repr)
    assert all(rows[r["id"]] == (r["doc_id"], r["text"]) for r in got.collect())


def test_the_index_is_read_by_bucket_without_a_shuffle(spark, tmp_path):
    index = DigestIndex.open(spark, str(tmp_path / "index"), 4)
    load_documents(docs_of(spark, ROWS), "one", index)
    digests = docs_of(spark, ROWS).selectExpr("unhex(sha2(text, 256)) AS digest").hint("merge")
    joined = digests.join(index.table().hint("merge"), "digest", "left_anti")
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Bucketed: true" in plan and plan.count("Exchange hashpartitioning") == 1


def test_loads_of_nothing(spark, tmp_path):
    none = docs_of(spark, ROWS).limit(0)
    index = DigestIndex.open(spark, str(tmp_path / "index"), 2)
    assert load_documents(none, "one", index).count() == 0 and new_documents(none, "two", index).count() == 0
    assert load_documents(none, "one", path=str(tmp_path / "other")).count() == 0
    with pytest.raises(ValueError):
        load_documents(none, "one")
    assert [buckets_for(n) for n in (0, 1, 32_000_000, 32_000_001)] == [8, 8, 8, 16]


def terms(text):
    return [x for x in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))]


def ranked(docs, items, limit=20):
    bags = [(i, Counter(terms(t))) for i, t in docs]
    bags = [(i, b) for i, b in bags if b]
    n_docs, n_terms = len(bags), sum(b.total() for _, b in bags)
    holders = Counter(w for _, b in bags for w in b)
    out = []
    for item, text in items:
        scores = []
        for doc, bag in bags:
            norm = 75 + 25 * bag.total() * n_docs // n_terms
            score = 0
            for word in terms(text):
                if bag[word]:
                    weight = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * holders[word] + 1)))
                    score += weight * (1_000_000_000 * bag[word] // (1000 * bag[word] + 12 * norm))
            if score > 0:
                scores.append((-score, doc is not None, doc or 0, doc))
        out += [(item, k, x[3], -x[0]) for k, x in enumerate(sorted(scores)[:limit], 1)]
    return sorted(out, key=repr)


def search_tables(seed, n=150):
    rng = random.Random(seed)
    pool = ["".join(rng.choice("abcdeé9") for _ in range(2)) for _ in range(30)]
    docs = [(i, " ".join(rng.choices(pool, k=rng.randint(1, 12)))) for i in range(n)]
    docs += [(1000 + i, "the Same, bag of words") for i in range(40)] + [(2000 - i, "words OF bag; the same") for i in range(40)]
    docs += [(3000, None), (3001, ""), (3002, " .;- \n"), (None, pool[0]), (5, pool[0]), (5, pool[0]), (3003, "x" * 100_000 + " " + pool[1] * 3)]
    docs += [(4000, (pool[2] + " ") * 20_000)]
    items = [(j, " ".join(rng.choices(pool + ["nowhere"], k=rng.randint(1, 8)))) for j in range(12)]
    items += [(50, "same words"), (51, None), (52, ""), (53, "nowhere"), (None, "bag"), (54, pool[0]), (54, pool[3]), (55, pool[0])]
    return docs, items


@pytest.mark.parametrize(("seed", "settings"), [
    (1, SearchSettings()), (2, SearchSettings(limit=3, words_per_pass=15, batch=7, broadcast_words=0)), (3, SearchSettings(limit=50, batch=1)),
])
def test_ranked_search(spark, seed, settings):
    docs, items = search_tables(seed)
    left = spark.createDataFrame([(*d, 1, "z") for d in docs], "doc_id long, text string, norm int, query string").repartition(5)
    right = spark.createDataFrame([(*i, 2) for i in items], "item_id long, text string, doc_id int")
    got = as_rows(rank_documents(left, right, settings), "item_id", "rank", "doc_id", "score")
    assert got == ranked(docs, items, settings.limit)


def test_search_in_nothing(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert rank_documents(docs.limit(0), items).count() == 0
    assert rank_documents(docs, items.limit(0)).count() == 0
    assert text_terms("a\x00B-É9".encode()) == [b"a", b"b", "É9".encode()]


def rebuilt(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", (text or "").encode()))
    own = {c: [x[2:] for x in sorted(turns)] for c, turns in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        opener = c - int(math.fmod(c, 5))
        out[c] = own.get(opener, [])[:h] + turns[h:]
    return own, out


def nodes_of(sequences):
    members = defaultdict(list)
    for conv, turns in sequences.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(conv)
    kids = Counter(path[:-1] for path in members if path)
    leaves, saved = Counter(), Counter()
    for path, convs in members.items():
        for d in range(len(path) + 1):
            leaves[path[:d]] += not kids[path]
            saved[path[:d]] += (len(convs) - 1) * len(path[-1][1]) if path else 0
    out = []
    for path, convs in members.items():
        ends = ",".join(str(c) for c in sorted(convs) if len(sequences[c]) == len(path))
        parent = min(members[path[:-1]]) if path else None
        digest = hashlib.sha256(ends.encode()).hexdigest()
        out.append((min(convs), len(path), parent, len(convs), kids[path], leaves[path], saved[path], digest))
    return sorted(out, key=repr)


NODE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
CONVERSATIONS = "conv_id long, turn long, role string, text string, place int, keys string, size int, n string"


def conversations(seed):
    """Branching conversations, a hot first turn, many equal ones, and odd rows."""
    rng = random.Random(seed)
    rows = []
    for conv in range(120):
        for turn in range(rng.randint(1, 12)):
            rows.append((conv, turn, rng.choice(["user", "assistant"]), rng.choice("abé") * (1 if turn < 3 else rng.randint(1, 3))))
    for conv in range(300, 380):
        rows += [(conv, t, "user", f"hot {t}") for t in range(6)] + [(conv, 6, "user", rng.choice("xyz"))] + [(conv, 7, "user", str(conv // 4))]
    for conv in range(500, 560):
        rows += [(conv, t, "user", "same") for t in range(10)]
    rows += [(-7, 0, "user", "neg"), (-5, 0, "user", "neg base"), (-5, 1, None, None), (-4, 3, "u", "v"), (-4, None, "u", "first"), (-4, None, "u", "first")]
    rows += [(None, 1, "user", "nobody"), (700, 0, None, None), (701, 0, "", ""), (702, 1, "user", "tie b"), (702, 1, "user", "tie a"), (702, 1, "a", "z")]
    rows += [(800, t, "user", f"long {t}") for t in range(300)] + [(801, 0, "user", "é" * 100_000)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("settings", [TrieSettings(), TrieSettings(shard_turns=40, broadcast_nodes=0), TrieSettings(shard_turns=4)])
def test_tries(spark, monkeypatch, settings):
    monkeypatch.setattr(prefix_trie, "IDS_PER_PIECE", 7)
    rows = conversations(4)
    frame = spark.createDataFrame([(*r, 1, "k", 2, "n") for r in rows], CONVERSATIONS).repartition(3)
    own, mixed = rebuilt(rows)
    sequences = turn_sequences(frame)
    assert as_rows(trie_nodes(with_openings(sequences), settings), *NODE) == nodes_of(mixed)
    assert as_rows(trie_nodes(sequences, settings), *NODE) == nodes_of(own)


def test_nodes_with_their_last_turn(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "bot", "b"), (2, 0, "user", "a"), (2, 1, "bot", None)]
    frame = spark.createDataFrame([(*r, 1, "k", 2, "n") for r in rows], CONVERSATIONS)
    got = as_rows(conversation_trie(frame), "conv_id", "depth", "n_convs", "role", "text")
    assert got == [(1, 0, 2, None, None), (1, 1, 2, "user", "a"), (1, 2, 1, "bot", "b"), (2, 2, 1, "bot", "")]


def test_tries_of_nothing(spark):
    frame = spark.createDataFrame([], CONVERSATIONS)
    assert trie_nodes(with_openings(turn_sequences(frame))).count() == 0
    lost = spark.createDataFrame([(3, 0, "user", "own", 1, "k", 2, "n")], CONVERSATIONS)  # takes over what is not there
    want = rebuilt([(3, 0, "user", "own")])[1]
    assert as_rows(trie_nodes(with_openings(turn_sequences(lost))), *NODE) == nodes_of(want)


def test_double_arrays():
    rng = random.Random(6)
    for _ in range(50):
        words = sorted({tuple(rng.randint(1, 40) for _ in range(rng.randint(0, 6))) for _ in range(rng.randint(1, 200))})
        trie = DoubleArray([list(w) for w in words])
        seen = {}
        for word in words:
            for d, state in enumerate(trie.path(list(word)), 1):
                assert seen.setdefault(state, word[:d]) == word[:d]  # one state, one prefix
        prefixes = {w[:d] for w in words for d in range(len(w) + 1)}
        assert len(trie.order) == len(set(trie.order)) == len(prefixes)
        with pytest.raises(KeyError):
            list(trie.path([99]))
    assert pa.types.is_int64(pa.array(trie.base).type)
