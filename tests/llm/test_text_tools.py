"""Chat formatting, archives, page text and word hashes: round trips and odd input."""

import dataclasses
import gzip
import hashlib
import html
import math
import random
import re
import time

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyworks.llm import warc, words
from tallyworks.llm.chat import as_replies, chosen_paths, conversation_digests, format_conversations, format_turns, read_turns, unescape
from tallyworks.llm.html_text import extract, main_texts, parse

marks = st.lists(st.sampled_from(["<s>", "</s>", "[INST]", "[/INST]", "\\", "\n", "l", "b", " ", "<", "[", "é", "\\l"]), max_size=12)


@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", None, "", "a[b\n"]), marks.map("".join)), max_size=6))
@settings(max_examples=200, deadline=None)
def test_turns_come_back(turns):
    made = format_turns(turns)
    assert read_turns(made.text) == turns
    loss = "".join(unescape(made.text[a:b]) for a, b in made.mask)
    assert loss == "".join(text for role, text in turns if role == "assistant")


def test_paths_of_trees(spark):
    rows = [
        ("t", 1, None, 0.0, "q"), ("t", 2, 1, 1.0, "bad"), ("t", 3, 1, 5.0, "good"), ("t", 4, 3, 2.0, "end"), ("t", 5, 3, 2.0, "tie"),
        ("u", 1, 9, None, "orphan"), ("c", 1, 2, 1.0, "circle"), ("c", 2, 1, 1.0, "circle"), ("s", 1, 1, 1.0, "self"),
        (None, 1, None, 1.0, "null tree"), (None, 2, 1, 1.0, "reply"),
    ]
    chain = [("long", i, i - 1 if i else None, 1.0, str(i)) for i in range(70)]
    frame = spark.createDataFrame(rows + chain, "tree string, id long, parent long, score double, text string")
    got = {}
    for r in chosen_paths(frame).collect():
        got.setdefault(r["tree"], {})[r["depth"]] = r["id"]
    assert got == {
        "t": {1: 1, 2: 3, 3: 4}, "u": {1: 1}, "s": {1: 1}, None: {1: 1, 2: 2}, "long": {i + 1: i for i in range(70)},
    }


def test_conversation_digests(spark):
    marks = "</s>[INST] ok [/INST]"
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", None), (1, 1, "assistant", "a"), (-7, 0, "user", marks), (-7, 1, "assistant", marks),
            (None, 0, None, "x"), (2, 0, "user", "y" * 50_000)]
    frame = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, tree string")
    got = {r["conv_id"]: r for r in conversation_digests(format_conversations(as_replies(frame))).collect()}
    assert set(got) == {1, -7, None, 2}
    for conv, row in got.items():
        own = sorted(((t, r, x) for c, t, r, x in rows if c == conv), key=lambda x: (x[0], str(x[1]), x[2] is not None, x[2]))
        said = "".join(f"{r or ''}\n{x or ''}\n" for _, r, x in own)
        loss = "".join(x or "" for _, r, x in own if r == "assistant")
        assert (row["n_turns"], row["turns_sha256"]) == (len(own), hashlib.sha256(said.encode()).hexdigest())
        assert (row["loss_chars"], row["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    empty = conversation_digests(format_conversations(as_replies(frame.limit(0))))
    assert empty.count() == 0


def page(n, body):
    return gzip.compress(warc.make_record(n, f"http://x/{n} y", body, None, False, "2024-01-01T00:00:00Z"), mtime=0)


def found(content):
    got = list(warc.salvage(content))
    gaps = [(r.offset, r.size) if r.inside is None else (r.offset, r.size, r.inside) for r in got if isinstance(r, warc.Gap)]
    return [r.headers["warc-record-id"] for r in got if not isinstance(r, warc.Gap)], gaps


def test_salvage_of_damaged_archives():
    rng = random.Random(1)
    members = [page(i, rng.randbytes(3000)) for i in range(6)]
    whole = b"".join(members)
    assert found(whole) == ([f"<urn:page:{i}>" for i in range(6)], [])
    at = len(members[0]) + 700
    broken = whole[:at] + b"\0" * 40 + whole[at + 40 :]
    assert found(broken) == ([f"<urn:page:{i}>" for i in (0, 2, 3, 4, 5)], [(len(members[0]), len(members[1]))])
    cut = whole[:-50]
    assert found(cut)[0] == [f"<urn:page:{i}>" for i in range(5)]
    assert found(b"junk" + whole) == ([f"<urn:page:{i}>" for i in range(6)], [(0, 4)])
    plain = b"".join(gzip.decompress(m) for m in members[:3])
    second = plain.index(b"urn:page:1>") + 1500
    lost = plain[:second] + bytes([plain[second] ^ 1]) + plain[second + 1 :]
    assert found(plain + members[3])[0] == [f"<urn:page:{i}>" for i in range(4)]
    names, gaps = found(lost)
    assert names == ["<urn:page:0>", "<urn:page:2>"] and len(gaps) == 1
    assert found(b"") == ([], []) and found(b"WARC/1.1\r\n") == ([], [(0, 10)])


def test_salvage_inside_members():
    rng = random.Random(2)
    records = [warc.make_record(i, "u", rng.randbytes(3000), None, False, "d") for i in range(3)]
    names = [f"<urn:page:{i}>" for i in range(3)]
    pack = lambda parts: gzip.compress(b"".join(parts), mtime=0)
    assert found(pack(records)) == (names, [])
    wrong = records[1][:-20] + bytes([records[1][-20] ^ 1]) + records[1][-19:]
    bad = pack([records[0], wrong, records[2]])
    assert found(bad) == ([names[0], names[2]], [(0, len(wrong), len(records[0]))])
    # Damaged or cut: what was unpacked before is kept if its digest matches, the rest is a gap of the file.
    whole = pack(records)
    for hurt in (whole[:-4000], whole[: len(whole) - 4000] + b"\xff" * 60 + whole[len(whole) - 3940 :]):
        got, gaps = found(hurt + page(9, b"next"))
        assert got == [names[0], "<urn:page:9>"] and gaps == [(0, len(hurt))]
    flipped = whole[:-8] + bytes([whole[-8] ^ 1]) + whole[-7:]  # the check of the member alone
    assert found(flipped) == (names, [(0, len(flipped))])
    revisit = warc.make_record(4, "u", b"x", 1, True, "d")
    assert found(pack([revisit])) == (["<urn:page:4>"], []) and found(pack([revisit])[:-1])[0] == []  # no proof without a payload


def test_headers_of_any_length(spark, tmp_path):
    rows = [(1, "u" * 100_000, "x"), (2, "http://" + "é \r\n" * 30_000, "y" * 2000), (3, "short", "z" * 300_000), (4, None, "w")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    warc.write_archives(frame, str(tmp_path / "a"))
    got = {r["page_id"]: r for r in warc.read_archives(spark, str(tmp_path / "a")).collect()}
    assert set(got) == {1, 2, 3, 4} and got[1]["url"] == "u" * 100_000
    assert {i: r["payload_bytes"] for i, r in got.items()} == {1: 1, 2: 2000, 3: 300_000, 4: 1}
    plain = b"".join(warc.make_record(i, u, h.encode(), None, False, "d") for i, u, h in rows)
    assert found(plain) == ([f"<urn:page:{i}>" for i in (1, 2, 3, 4)], [])
    began = time.monotonic()
    assert found(b"WARC/1.1\r\n" * 100_000)[0] == [] and time.monotonic() - began < 5


def test_files_are_bounded_by_bytes(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, "u", "".join(rng.choices("abcdefghij", k=5000))) for i in range(60)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    warc.write_archives(frame, str(tmp_path / "a"), warc.ArchiveSettings(bytes_per_file=20_000))
    sizes = [p.stat().st_size for p in (tmp_path / "a").rglob("part-*")]
    assert len(sizes) > 5 and max(sizes) < 26_000
    got = warc.read_archives(spark, str(tmp_path / "a"), payloads=True).collect()
    assert {r["page_id"]: bytes(r["payload"]).decode() for r in got} == {i: h for i, _, h in rows}


def test_archives_round_trip(spark, tmp_path):
    long = "é<p>" * 400
    rows = [(1, "u1", long), (2, None, long), (5, "u\r\n5", long), (3, "u3", "short"), (4, "u4", "short"), (6, "u6", None), (7, "", ""),
            (None, "n", long), (9, "u9", "a" * 999), (10, "u10", "a" * 999), (11, "x", "a" * 1000), (12, "x", "a" * 1000)]
    frame = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, digest string")
    warc.write_archives(frame, str(tmp_path / "a"))
    got = warc.read_archives(spark, str(tmp_path / "a")).collect()
    assert all(r["gap_bytes"] is None for r in got)
    want = set()
    for page_id, _, html in rows:
        data = (html or "").encode()
        top = max((p for p, _, h in rows if h == html and p is not None), default=None) if len(data) >= 1000 else None
        again = top is not None and page_id != top
        kind, refers = ("revisit", top) if again else ("response", None)
        want.add((page_id, len(data), hashlib.sha1(data).hexdigest(), kind, refers))
    assert {(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got} == want
    assert len(got) == len(rows)


def test_archives_of_no_pages(spark, tmp_path):
    frame = spark.createDataFrame([], "page_id long, url string, html string")
    warc.write_archives(frame, str(tmp_path / "none"))
    assert warc.read_archives(spark, str(tmp_path / "none")).count() == 0


BODY = "<p>First &amp; <b>bo</b>ld   text that goes on for a while.</p><p>Short.</p>\n<ul><li>One point, <a href=x>linked</a><li>Two</ul>"


def test_main_text_layouts():
    want = "A Title First & bold text that goes on for a while. Short. One point, linked Two"
    around = "<header><a href=/>Site</a></header><nav><ul><li><a href=a>Menu one</a></ul></nav>{}<aside>Also read this long text of a sidebar</aside><footer>&copy; all rights</footer>"
    for article in (
        f"<article><h1>A Title</h1>{BODY}</article>",
        f"<main><h1>A Title</h1><div class=text>{BODY}</div><div class='ad-box'>Buy now, buy a lot of it now</div></main>",
        f"<article><header><h1>A Title</h1></header>{BODY}<section id=comments><p>I liked it, a very long comment indeed.</p></section></article>",
        f"<article><h1>A Title</h1>{BODY}<form><label>Mail</label><input></form><script>if (a<b) '</p>'</script></article>",
        f"<ARTICLE><H1>A Title</H1><!-- <p>no</p> -->{BODY}<div hidden>secret words here</div><style>p{{}}</style></ARTICLE>",
    ):
        assert extract(f"<!DOCTYPE html><html><head><title>T</title></head><body>{around.format(article)}</body></html>") == want


def test_main_text_of_odd_pages(spark):
    assert extract("") == "" and extract("<p") == "<p" and extract("<div><br></div>") == ""
    assert extract("just text") == "just text"
    assert extract("<article><p>open <b>and never closed <p>next") == "open and never closed next"
    assert extract("<div>" * 5000 + "deep" + "</div>" * 5000) == "deep"
    assert extract('<a href="unclosed>x</a><p>rest of it</p>') != ""
    frame = spark.createDataFrame([(1, "u", None, 3), (1, "u", None, 3), (None, None, "<p>é</p>", 4)], "page_id long, url string, html string, n_chars int")
    got = sorted((str(r["page_id"]), r["text"], r["n_chars"]) for r in main_texts(frame).collect())
    assert got == [("1", "", 0), ("1", "", 0), ("None", "é", 1)]
    assert main_texts(frame.limit(0)).count() == 0


@given(st.lists(st.sampled_from(["a", "B", "é", " ", "\t", "\n", "\x0b", "\x1c", "\xa0", "xyz"]), max_size=60))
@settings(max_examples=200, deadline=None)
def test_word_hashes_follow_the_words(parts):
    data = "".join(parts).encode()
    split = data.lower().split()
    hashes = words.word_hashes(data)
    assert len(hashes) == len(split)
    assert [int(h) for h in hashes] == [int(words.word_hashes(w)[0]) for w in split]
    runs = words.run_hashes(hashes, 5)
    assert len(runs) == (max(1, len(split) - 4) if split else 0)
    if len(split) >= 5:
        assert runs[-1] == words.run_hashes(words.word_hashes(b" ".join(split[-5:])), 5)[0]


def test_word_hashes_of_long_texts():
    data = b"Aa bb " + b"x" * 200_000 + b" cc aA" + b" q" * 100_000 + b" " * 70_000
    hashes = words.word_hashes(data)
    assert len(hashes) == len(data.split())
    assert hashes[0] == hashes[4] and hashes[2] == words.word_hashes(b"X" * 200_000)[0]
    order = words.run_hashes(words.word_hashes(b"a b c d e"), 5), words.run_hashes(words.word_hashes(b"a b d c e"), 5)
    assert order[0][0] != order[1][0]
    assert len(np.unique(words.word_hashes(" ".join(map(str, range(50_000))).encode()))) == 50_000


def words_of(n, tag="p", count=3):
    return "".join(f"<{tag}>{' '.join(f'word{n}{i}{j}' for j in range(12))}.</{tag}>" for i in range(count))


def plain(source):
    return " ".join(html.unescape(re.sub(r"<[^>]*>", " ", source)).split())


def test_main_text_in_several_places():
    one, two, menu = words_of(1), words_of(2), "<nav><ul><li><a href=a>Menu one</a></ul></nav>"
    for around in ("{}", f"{menu}{{}}", f"<div id=page>{menu}<div class=main-column>{{}}</div></div>"):
        both = f"{plain(one)} {plain(two)}"
        assert extract(around.format(f"<main><article>{one}</article><article>{two}</article></main>")) == both
        assert extract(around.format(f"<div>{one}</div><div>{two}</div>")) == both
        assert extract(around.format(f"<section>{one}</section><div><div>{two}</div></div>")) == both
        assert extract(around.format(f"<div>{one}{two}</div>")) == both
    links = "<ul>" + "<li><a href=x>Another story to read</a></li>" * 8 + "</ul>"
    teaser = "<article><a href=x>Read on</a></article>"
    assert extract(f"<main><article>{one}</article>{teaser * 3}</main><div>{links}</div>") == plain(one)


def test_main_text_keeps_what_is_about_a_label():
    for part in (
        "<section id=privacy><h2>Privacy</h2><p>What the law says.</p></section>", "<p class=legal-history>It began long ago.</p>",
        "<section id='cookie'><p>How to bake one, with much butter.</p></section>", "<div class='search-algorithms'><p>Trees and tables.</p></div>",
    ):
        assert extract(f"<body><article><h1>Title</h1>{words_of(1)}{part}</article></body>") == f"Title {plain(words_of(1))} {plain(part)}"
    for part in (
        "<div class=ad-box>Buy now</div>", "<section id=comments><p>I liked it very much indeed</p></section>", "<p class='share-links'>Tell all</p>",
        "<div class='cookie-notice'>We use cookies</div>", "<div class=notice>You have two articles left</div>", "<div id=related-posts>More</div>",
    ):
        assert extract(f"<body><article><h1>Title</h1>{words_of(1)}{part}</article></body>") == f"Title {plain(words_of(1))}"


def test_broken_markup_is_read_in_one_go():
    for part, end in (("<a", ""), ("<a", ">"), ("<a '", ""), ('<a href="', ">"), ("<!--", ""), ("</a", ""), ("<!", ""), ("<span class=ad-box>", ""), ("<article>", "")):
        began = time.monotonic()
        extract(part * (1_000_000 // len(part)) + end)
        assert time.monotonic() - began < 5, part
    assert extract("<p>one</p><!-- <p>no</p> --!><p>two</p><!-- open <p>three</p>") == "one two"


def slow_text(page):
    """The choice of text from its definition, node by node."""
    nodes = page.nodes
    kids = [[j for j, n in enumerate(nodes) if n.parent == i and not n.dropped] for i in range(len(nodes))]
    own = [[(t, n) for n, t in page.blocks if n == i] for i in range(len(nodes))]
    total = lambda i, what: what(i) + sum(total(j, what) for j in kids[i])
    chars = lambda i: total(i, lambda k: sum(len(t) for t, _ in own[k]))
    links = lambda i: total(i, lambda k: seen[k].link_chars)
    tags = lambda i: total(i, lambda k: seen[k].tags) + total(i, lambda k: 1) - 1
    link_tags = lambda i: total(i, lambda k: seen[k].link_tags)
    seen = [dataclasses.replace(n) for n in nodes]
    share = links(0) / chars(0) if chars(0) else 0

    def density(c, lc, t, lt):
        if not c:
            return 0.0
        t, lc1, lt = max(1, t), max(1, lc), max(1, lt)
        base = math.log(math.log(c / max(1, c - lc) * lc1 + share * c + math.e))
        return c / t * max(0.0, math.log(max(1.0, c / lc1 * t / lt))) / max(base, 0.05)

    dense = [density(chars(i), links(i), tags(i), link_tags(i)) for i in range(len(nodes))]
    mine = [sum(len(t) for t, _ in own[i]) for i in range(len(nodes))]
    sums = [
        sum(dense[j] for j in kids[i]) + (density(mine[i], min(links(i), mine[i]), 1, 1 if links(i) else 0) if mine[i] else 0) for i in range(len(nodes))
    ]
    under = lambda i: [i] + [k for j in kids[i] for k in under(j)]
    top = lambda i: max(under(i), key=lambda k: (round(sums[k], 6), -k))
    path = [top(0)]
    while path[-1]:
        path.append(nodes[path[-1]].parent)
    least = min(dense[i] for i in path)
    kept = {k for i in under(0) if dense[i] >= least * (1 - 1e-9) for k in under(top(i))}
    return " ".join(t for n, t in page.blocks if n in kept)


@given(st.recursive(
    st.lists(st.sampled_from(["word ", "some longer text here ", "<a href=x>link text</a> ", "x ", "<b>bold</b> "]), max_size=4).map("".join),
    lambda inner: st.tuples(st.sampled_from(["div", "p", "section", "ul", "li"]), st.lists(inner, min_size=1, max_size=4)).map(
        lambda x: f"<{x[0]}>{''.join(x[1])}</{x[0]}>"), max_leaves=25,
))
@settings(max_examples=150, deadline=None)
def test_text_choice_from_its_definition(source):
    page = parse(source)
    assert extract(source) == (slow_text(page) if page.blocks else "")
