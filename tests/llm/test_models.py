"""Toxicity, language model, mixing, embeddings and the pipeline on small and odd tables."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tallyworks.llm import toxicity
from tallyworks.llm.embedding_lsh import LshSettings, near_vectors
from tallyworks.llm.language_model import (
    ModelSettings,
    class_of,
    learn_vocabulary,
    log_probabilities,
    score_texts,
    train,
    word_keys,
)
from tallyworks.llm.mixing import mixed, mixture
from tallyworks.llm.queries import QUERIES
from tallyworks.llm.toxicity import ToxicitySettings, features, fit, judge, learn, score_documents, toxic_documents, without_toxic

DOCS = "doc_id long, text string, source string, score double, row long, place int, size string"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, s, 0.5, 1, 2, "x") for i, t, s in rows], DOCS).repartition(3)


def bags(n=400, seed=2):
    """Random prose; a tenth of it holds one of a few insults, inflected, in one sentence."""
    rng = random.Random(seed)
    syllables = ["an", "er", "on", "the", "in", "re", "st", "ou", "ti", "ha"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    rows, labels = [], []
    for i in range(n):
        lines = [[word() for _ in range(rng.randint(4, 12))] for _ in range(rng.randint(1, 8))]
        toxic = i % 5 == 0
        if toxic:
            line = rng.choice(lines)
            line.insert(rng.randint(0, len(line)), rng.choice(["Zqidiot", "grubble"]) + rng.choice(["", "ing", "s!"]))
        rows.append((i, ". ".join(" ".join(line) for line in lines) + ".", f"s{i % 4}"))
        labels.append((i, int(toxic)))
    return rows, labels


def test_toxicity_finds_documents_and_sentences(spark):
    rows, labels = bags()
    odd = [(1000, None, None), (1001, "", "s1"), (None, "you grubble", "s1"), (1002, "fine. " * 20000 + "Some Zqidiot here. fine.", "s")]
    frame = documents(spark, rows + odd)
    marks = spark.createDataFrame([(i, None, y) for i, y in labels] + [(5000, 1, 1), (None, 0, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    got = {(r["doc_id"]): r for r in toxic_documents(frame, marks).collect()}
    assert len(got) == len(rows) + len(odd)
    truth = dict(labels)
    out = [i for i, _ in labels if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(got[i]["held_out"] == (i in out) for i, _ in labels)
    right = [got[i]["predicted"] == truth[i] for i in out]
    assert sum(right) >= 0.95 * len(right)
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert got[1000]["score"] == got[1001]["score"] < 0.3 and got[None]["predicted"] == 1
    text = "fine. " * 20000 + "Some Zqidiot here. fine."
    assert ["Zqidiot" in text[s["start"] : s["stop"]] for s in got[1002]["spans"]] == [True]
    kept = without_toxic(frame, marks)
    assert kept.columns == frame.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, r in got.items() if r["predicted"] == 0}


def test_toxicity_without_both_labels(spark):
    frame = documents(spark, [(1, "a b", "s")])
    for marks in ([], [(1, 0)], [(1, 1)]):
        model = learn(frame, spark.createDataFrame(marks, "doc_id long, toxic int"), ToxicitySettings(steps=2))
        assert model.weights == {}
        assert 0 <= score_documents(frame, model).first()["score"] <= 1


def test_language_model_scores(spark):
    rng = random.Random(4)
    grammar = {"a": "bb c", "b": "cc a", "c": "aa b"}
    rows = []
    for i in range(899):
        words, now = [], rng.choice("abc")
        for _ in range(rng.randint(0, 60)):
            words.append(now.upper() if rng.random() < 0.1 else now)
            now = rng.choice(grammar[now].replace(" ", "")) if rng.random() < 0.95 else rng.choice("abc")
        if i % 7 == 0:
            words.append(f"rare{i % 21}")
        rows.append((i, " ".join(words), "s"))
    long = next(i for i in range(1000, 2000) if zlib.crc32(str(i).encode()) % 7 == 2)  # scored, not learned from
    rows += [(900, None, None), (901, "", "s"), (None, "a b", "s"), (902, "zz\vnever", "s"), (5, "a", "s"), (long, "a b c " * 30_000, "s")]
    settings = ModelSettings(words=3, table_words=3, batch=64)
    got = score_texts(documents(spark, rows), settings).collect()
    assert len(got) == len(rows)
    counts, total = Counter(), 0
    tokens = [(i, [*(t or "").encode().lower().split(), None]) for i, t, _ in rows]
    for i, t in tokens:
        if i is None or zlib.crc32(str(i).encode()) % 7 != 2:
            counts.update(t)
            total += len(t)
    want = Counter()
    for i, t in tokens:
        base = sum(math.log10((counts[w] + 1) / (total + len(counts) + 1)) for w in t)
        want[(i, i is not None and zlib.crc32(str(i).encode()) % 7 == 2, len(t), sum(counts[w] > 0 for w in t), total, round(base, 6))] += 1
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
    own = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in own) > sum(r["base_score"] for r in own)


def test_class_probabilities_sum_to_one():
    rng = np.random.default_rng(1)
    values = {"inputs": rng.normal(size=(9, 4)), "outputs": rng.normal(size=(9, 4)), "near": rng.normal(size=(4, 4)),
              "far": rng.normal(size=(4, 4)), "bias": rng.normal(size=9)}
    logs = log_probabilities(values, np.full(9, 2), np.full(9, 7), np.arange(9))
    assert abs(np.exp(logs).sum() - 1) < 1e-5


def test_language_model_without_training_texts(spark):
    assert score_texts(documents(spark, [])).count() == 0
    lone = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    row = score_texts(documents(spark, [(lone, "a b", "s")])).first()
    assert (row["train_tokens"], row["n_known"], row["n_tokens"]) == (0, 0, 3) and math.isfinite(row["score"])


def small_corpus():
    rng = random.Random(9)
    after = {w: rng.sample("abcdefgh", 2) for w in "abcdefgh"}
    rows = []
    for i in range(400):
        words = [rng.choice("abcdefgh")]
        while len(words) < 40:
            words.append(rng.choice(after[words[-1]]))
        if i % 5 == 0:
            words[rng.randrange(40)] = f"rare{rng.randint(0, 30)}"
        rows.append((i, " ".join(words), "s"))
    return rows + [(1, rows[1][1], "s")] * 100  # copies with the same id


def test_language_model_does_not_depend_on_splits(spark):
    frame = documents(spark, small_corpus())
    settings = ModelSettings(batch=256, shard_tokens=700)
    found = []
    for splits in (1, 3, 40):
        rows = score_texts(frame.repartition(splits), settings).select("doc_id", "base_score", "score").collect()
        assert len(rows) == 500
        found.append((sum(r["score"] for r in rows), sum(r["base_score"] for r in rows)))
    assert all(abs(s - found[0][0]) < 0.01 * abs(found[0][0]) for s, _ in found)
    assert all(abs(b - found[0][1]) < 1e-6 * abs(b) for _, b in found)
    assert all(s > b * 0.85 for s, b in found)  # two followers a word: far above single counts


def test_language_model_own_words_grow_with_the_corpus():
    sizes = [ModelSettings().own_words(n) for n in (0, 1, 1_000, 1_000_000, 1_000_000_000)]
    assert sizes == sorted(set(sizes)) and sizes[0] == 0 and sizes[-1] > 50 * sizes[2]
    assert ModelSettings(words=7).own_words(1_000_000) == 7


def test_language_model_score_against_a_plain_softmax(spark):
    rows = small_corpus()[:60] + [(900, "zz never a b", "s"), (901, "", "s"), (902, None, "s")]
    settings = ModelSettings(words=5, table_words=6, batch=64, size=4)
    frame = documents(spark, rows)
    rest = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 7 != 2]
    texts = documents(spark, rest).select("doc_id", F.col("text").cast("binary").alias("text"))
    vocabulary, _ = learn_vocabulary(texts, settings)
    values = train(texts, vocabulary, settings)
    counts = Counter(w for _, t, _ in rest for w in (t or "").lower().split())
    classes = {w: int(class_of(word_keys(w.encode()), vocabulary)[0][0]) for _, t, _ in rows for w in (t or "").lower().split()}
    n_classes = len(vocabulary.class_counts)
    mass = Counter()
    for w, c in counts.items():
        if classes[w] >= vocabulary.words:
            mass[classes[w]] += c + 1
    want = {}
    for i, text, _ in rows:
        words = (text or "").lower().split()
        total, far, near = 0.0, vocabulary.end, vocabulary.end
        for w in [*words, None]:
            c = vocabulary.end if w is None else classes[w]
            guess = values["near"].T @ values["inputs"][near] + values["far"].T @ values["inputs"][far]
            scores = [math.exp(float(guess @ values["outputs"][k] + values["bias"][k])) for k in range(n_classes)]
            total += math.log10(scores[c] / sum(scores))
            if w is not None and c >= vocabulary.words:
                total += math.log10((counts[w] + 1) / (mass[c] + 1))
            far, near = near, c
        want[i] = total
    for row in score_texts(frame, settings).collect():
        assert abs(row["score"] - want[row["doc_id"]]) < 2e-3 * max(1, abs(want[row["doc_id"]])), row


def targets_of(sizes):
    """Water-filling over (source, words), by code point, null last."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    total, fixed = sum(sizes.values()), {}
    while True:
        rest = [s for s in order if s not in fixed]
        left = total - sum(fixed.values())
        share = {s: left * weight[s] / sum(weight[x] for x in rest) for s in rest}
        over = [s for s in rest if share[s] > 3 * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: 3 * sizes[s] for s in over}


def test_mixture_meets_targets(spark):
    rng = random.Random(8)
    rows = [(i, "w " * rng.randint(1, 40), rng.choice(["b", "b", "b", "B", "é", "z"])) for i in range(900)]
    rows += [(i, "w " * 10, None) for i in range(900, 903)] + [(950, None, "b"), (951, "", "tiny"), (952, "a\x0bb\x1cc", "tiny"), (None, "x", "z"), (3, "again", "b"), (3, "again", "b")]
    frame = documents(spark, rows)
    got = mixture(frame).collect()
    size = lambda t: len((t or "").encode().split())
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((i, size(t)) for i, t, _ in rows)
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += size(t)
    want = targets_of(sizes)
    where = {}
    for i, _, s in rows:
        where.setdefault(i, s)
    taken = Counter()
    for r in got:
        s = where[r["doc_id"]]
        assert r["source_size"] == sizes[s] and abs(r["target"] - want[s]) < 1e-6 and 0 <= r["taken"] <= 3 * r["size"]
        taken[s] += r["taken"]
    for s, goal in want.items():
        assert abs(taken[s] - goal) <= 40
    assert Counter((r["doc_id"], r["taken"]) for r in mixture(frame.repartition(5)).collect()) == Counter((r["doc_id"], r["taken"]) for r in got)
    order = mixed(frame)
    assert order.columns == [*frame.columns, "mix_time"]
    rows_out = order.collect()
    times = [r["mix_time"] for r in rows_out]
    assert times == sorted(times) and all(0 <= t <= 1 for t in times)
    assert sum(size(r["text"]) for r in rows_out) == sum(taken.values())
    # The heavy source's weight falls over the run.
    heavy = [r["mix_time"] for r in rows_out if r["source"] == "B"]
    assert sum(t < 0.5 for t in heavy) > 1.2 * sum(t >= 0.5 for t in heavy)


def test_mixture_is_read_off_the_training_order(spark):
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(1 + i * 7 % 40)), "abc"[i % 3]) for i in range(300)]
    frame = documents(spark, [*rows, (900, None, "a"), (901, "", None)])
    order = [(r["doc_id"], r["mix_time"]) for r in mixed(frame).collect()]
    got = {r["doc_id"]: r for r in mixture(frame).collect()}
    assert len(got) == 302 and 0 < len(order)
    sizes, seen = Counter(), {}
    for step, (doc_id, time) in enumerate(order, 1):
        sizes[doc_id] += got[doc_id]["size"]
        seen.setdefault(doc_id, (time, step))
    assert {d: r["taken"] for d, r in got.items()} == {d: sizes[d] for d in got}
    assert {d: (r["first_time"], r["first_step"]) for d, r in got.items()} == {d: seen.get(d, (None, None)) for d in got}


def test_mixture_of_nothing(spark):
    assert mixture(documents(spark, [])).count() == 0
    assert mixed(documents(spark, [])).count() == 0
    assert mixture(documents(spark, [(1, None, "a")])).first()["taken"] == 0


@pytest.mark.parametrize("block", [1024, 8])
def test_near_vectors_match_brute_force(spark, block):
    rng = np.random.default_rng(3)
    rows = []
    for label in (0, 1):
        for _ in range(30):
            base = rng.normal(size=8)
            for _ in range(rng.integers(1, 4)):
                rows.append((base + rng.normal(size=8) * 0.1, label))
    base = rng.normal(size=8)
    rows += [(base + rng.normal(size=8) * 0.02, 1) for _ in range(40)] + [(base, 1)] * 5 + [(base * 3, 1), (base, None), (base * 0, 1), (base[:4], 1)]
    rows = [(i, [float(np.float32(x)) for x in v], lab) for i, (v, lab) in enumerate(rows)]
    n = len(rows)
    rows += [(n, None, 1), (n + 1, [], 1), (n + 2, [1.0, None], 1), (n + 3, [float("nan")] * 8, 1), (n + 4, [float("inf")] * 8, 1), (None, rows[0][1], 0)]
    frame = spark.createDataFrame([(*r, "c") for r in rows], "vec_id long, embedding array<float>, label int, rep string").repartition(3)
    got = near_vectors(frame, LshSettings(block=block)).collect()
    assert len(got) == len(rows)
    links = {i: set() for i, _, _ in rows if i is not None}
    usable = [(i, np.array(v), lab) for i, v, lab in rows[:n] if lab is not None and np.any(v)]
    for k, (i, a, x) in enumerate(usable):
        for j, b, y in usable[:k]:
            if x == y and len(a) == len(b) and a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= 0.93:
                links[i].add(j)
                links[j].add(i)
    name = {i: i for i in links}
    for _ in range(len(name)):
        name = {i: min([name[i], *(name[j] for j in near)]) for i, near in links.items()}
    found = {r["vec_id"]: r for r in got if r["vec_id"] is not None}
    total, right = sum(map(len, links.values())), sum(r["n_links"] for r in found.values())
    assert all(r["n_links"] <= len(links[i]) for i, r in found.items()) and right >= 0.9 * total
    assert sum(r["component_id"] == name[i] for i, r in found.items()) >= 0.98 * len(name)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in found.values())
    assert LshSettings().recall(0.93) > 0.99


def test_pipeline_stages(spark, tmp_path):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
    assert docs.count() > 0 and "mix_time" in docs.columns


def test_queries_are_registered():
    assert [name.split("_")[0] for name in QUERIES] == [f"op{i}" for i in range(1, 11)]


def test_scores_do_not_grow_with_plain_length():
    rng = random.Random(8)
    plain = ["the day was long", "we went home", "rain fell on hills", "they read books", "he met her there"]
    bags = []
    for i in range(300):
        toxic = i % 3 == 0
        parts = [rng.choice(plain) for _ in range(rng.randint(1, 30))] + ["you are a stupid fool"] * toxic
        rng.shuffle(parts)
        bags.append((int(toxic), ". ".join(parts).encode()))
    model = fit(bags, {0: 1.0, 1: 1.0}, ToxicitySettings())
    clean, bad = ". ".join(plain * 4000), "You are a stupid fool."
    assert judge(clean.encode(), model, 0.3)[0] < 0.3 <= judge(f"{clean}. {bad}".encode(), model, 0.3)[0]
    assert sum((judge(text, model, 0.3)[0] >= 0.3) == bool(y) for y, text in bags) == len(bags)

    def slow(text):
        """The noisy-or, sentence by sentence."""
        back, left = 1 / (1 + math.exp(-model.bias)), 1.0
        for sentence in re.split("[.!?\n\r]", text.lower()):
            hits = [w for w in features(sentence.encode().split()) if w in model.weights]
            p = 1 / (1 + math.exp(-model.bias - sum(model.weights[w] for w in hits))) if hits else back
            left *= (1 - max(p, back)) / (1 - back)
        return 1 - left * (1 - back)

    for text in ["", "the fool", bad, bad * 3, "stupid. you are. fool", *(t.decode() for _, t in bags[:40])]:
        assert judge(text.encode(), model, 0.3)[0] == pytest.approx(slow(text), abs=1e-9)


def test_toxicity_sample_is_bounded(spark):
    """Repeated rows and ids cost one text, and texts stop at the bytes."""
    docs = [(i, f"fool {i}" if i % 2 else f"nice {i}") for i in range(40)] + [(1, "x" * 5000)] * 50 + [(3, None), (None, "y")]
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(1, 1)] * 3, "doc_id long, toxic int")
    frame = spark.createDataFrame([(*d, "own") for d in docs], "doc_id long, text string, hash string")
    seen = []
    learned = toxicity.fit
    for size in (1 << 25, 60):
        toxicity.fit = lambda bags, *rest: seen.append(bags) or learned(bags, *rest)
        try:
            toxicity.learn(frame, labels, ToxicitySettings(sample_bytes=size))
        finally:
            toxicity.fit = learned
    assert len(seen[0]) <= 40 and 0 < len(seen[1]) < len(seen[0])
    assert all(sum(len(t) for y, t in seen[1] if y == label) <= 60 for label in (0, 1))
