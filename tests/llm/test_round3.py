"""Fingerprints, product codes and prefix tries against plain versions; the SQL of this folder's queries."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from dialogscope.llm import exponion, prefix_trie, registry, syncmers

SF = "/root/testdata/sf0.001"
TABLES = "documents embeddings pages benchmark labels conversations".split()


def _plain(x):
    if x is None or x != x:
        return "null"
    return str(x) if isinstance(x, (bool, str)) else f"{float(x):.6g}"


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_matches_sql(spark, name):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = registry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    want = c.sql(registry.ORACLE_SQL[name])
    assert sorted(want.columns) == columns
    at = [want.columns.index(x) for x in columns]
    rows = want.fetchall()
    assert sorted(tuple(map(_plain, r)) for r in df.select(*columns).collect()) == sorted(tuple(_plain(r[i]) for i in at) for r in rows)


# fingerprints


def _anchors(data: bytes, k: int, s: int) -> dict[int, int]:
    """Hash (48 bits) to first position of the closed syncmers, or of the whole text."""
    found = {}
    for i in range(len(data) - k + 1):
        inner = [np.int64(np.uint64(xxhash.xxh64_intdigest(data[i + j : i + j + s], seed=42))) for j in range(k - s + 1)]
        if min(inner) in (inner[0], inner[-1]):
            found.setdefault(xxhash.xxh64_intdigest(data[i : i + k], seed=42) >> 16, i)
    if not found and data:
        found[xxhash.xxh64_intdigest(data, seed=42) >> 16] = 0
    return found


def _sketch(data: bytes, k: int, s: int, sketch: int) -> list[tuple[int, int]]:
    return sorted(_anchors(data, k, s).items())[:sketch]


def _likeness(a: list, b: list, sketch: int) -> float:
    bound = min([x[-1][0] for x in (a, b) if len(x) == sketch], default=math.inf)
    a, b = ({h: p for h, p in x if h <= bound} for x in (a, b))
    offsets = Counter(a[h] - b[h] for h in a.keys() & b.keys())
    matches = sum(n for n in offsets.values() if n > 1) or min(1, sum(offsets.values()))
    return 2 * matches / (len(a) + len(b)) if a or b else 1.0


def _written(x: list) -> str:
    return " ".join(f"{h:012x}@{p:x}" for h, p in x)


def _texts(rng: random.Random) -> list:
    words = ["th", "er", "né", "日本", "ing ", " ", "\n", "and ", "🙂"]
    texts = ["".join(rng.choice(words) for _ in range(rng.choice([0, 1, 3, 8, 30, 200]))) for _ in range(40)]
    passage = "".join(rng.choice(words) for _ in range(60))
    return [*texts, None, "", "a", "a" * 300, "twice the same text", "twice the same text", passage + " left", "right " + passage, texts[-1]]


@pytest.mark.parametrize("sketch", [8, 1000])
def test_fingerprints_of_texts_and_edited_texts(spark, sketch, monkeypatch):
    """Chunks of 16 bytes, ranges of few rows: the assembled fingerprints are those of the texts made by hand."""
    monkeypatch.setattr(syncmers.sketches, "__defaults__", (*syncmers.sketches.__defaults__[:3], 16))
    texts = _texts(random.Random(4))
    docs = {i * 3 - 20: t or "" for i, t in enumerate(texts)}
    rows = [(i * 3 - 20, t, "x", 1.0) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string, n_chars double").repartition(3)
    got = {r["doc_id"]: r for r in syncmers.edited_pairs(df, 8, 3, sketch).collect()}
    ids = sorted(docs, reverse=True)
    assert got.keys() == docs.keys()
    for i, d in enumerate(ids):
        text, other = docs[d], docs[ids[(i + 1) % len(ids)]]
        n = len(text) // 3
        edited = text[: len(text) - n] + other[:n]
        own, changed, after = (_sketch(x.encode(), 8, 3, sketch) for x in (text, edited, other))
        r = got[d]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert (r["fingerprint"], r["edited_fingerprint"]) == (_written(own), _written(changed))
        assert r["near_edited"] == pytest.approx(_likeness(own, changed, sketch)) and r["near_next"] == pytest.approx(_likeness(own, after, sketch))
    alone = {r["doc_id"]: r["fingerprint"] for r in syncmers.fingerprints(df, 8, 3, sketch).collect()}
    assert alone == {d: r["fingerprint"] for d, r in got.items()}


def test_fingerprints_of_awkward_tables(spark):
    schema = "doc_id long, text string"
    assert syncmers.edited_pairs(spark.createDataFrame([], schema)).collect() == []
    (one,) = syncmers.edited_pairs(spark.createDataFrame([(7, "a text on its own, its own next")], schema)).collect()
    assert one["near_next"] == 1.0
    long = "".join(random.Random(1).choice("abcdefgh ") for _ in range(300_000))
    rows = [(None, None), (None, "no id"), (5, long), (5, long), (5, "other"), (None, "no id")]
    got = syncmers.edited_pairs(spark.createDataFrame(rows, schema).repartition(4)).collect()
    assert sorted(r["n_chars"] for r in got) == [0, 5, 5, 5, 300_000, 300_000]
    by = defaultdict(set)
    for r in got:
        by[r["n_chars"], r["doc_id"]].add(r["fingerprint"])
    assert all(len(x) == 1 for x in by.values()) and by[0, None] == {""}


def test_likeness_tells_edited_texts_from_others(spark):
    rows = [r for r in syncmers.edited_pairs(spark.read.parquet(f"{SF}/documents.parquet")).collect() if r["n_chars"] >= 100]
    assert sum(r["near_edited"] > 0.4 for r in rows) >= 0.9 * len(rows)
    assert sum(r["near_next"] < 0.1 for r in rows) >= 0.9 * len(rows)
    assert sum(r["near_edited"] > r["near_next"] for r in rows) >= 0.98 * len(rows)


# product codes


def _codes(vectors: dict, labels: dict, parts: int = 16, entries: int = 64):
    ints = {k: [math.floor(256 * x) if abs(x) < 1e15 else int(x) * 256 for x in v] for k, v in vectors.items()}
    width = len(next(iter(ints.values()))) // parts
    cut = {k: [v[i * width : (i + 1) * width] for i in range(parts)] for k, v in ints.items()}
    books = [[cut[k][p] for k in sorted(cut)[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    for turn in range(3):
        code = {k: [min((far(c, e), i) for i, e in enumerate(books[p])) for p, c in enumerate(v)] for k, v in cut.items()}
        if turn < 2:
            for p in range(parts):
                mine = defaultdict(list)
                for k in cut:
                    mine[code[k][p][1]].append(cut[k][p])
                books[p] = [[sum(c) // len(mine[i]) for c in zip(*mine[i], strict=True)] if i in mine else e for i, e in enumerate(books[p])]
    error = {k: sum(d for d, _ in v) for k, v in code.items()}
    total = defaultdict(int)
    for k in cut:
        total[labels[k]] += error[k]
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    most = 2**63 - 1
    return {k: ("".join(f"{i:02x}" for _, i in code[k]), min(error[k], most), min(total[labels[k]], most), sha) for k in cut}


SCHEMA = "vec_id long, embedding array<float>, label int, code string, error double"


@pytest.mark.parametrize("huge", [False, True])
def test_codes_are_those_of_a_full_search(spark, huge):
    rng = np.random.default_rng(3)
    vectors = {i * 7 - 100: np.float32(rng.normal(size=32) * rng.choice([0.001, 1, 30])).tolist() for i in range(150)}
    vectors |= {-1: vectors[-100], -2: [0.0] * 32, -3: [float(np.float32(1e-30))] * 32}
    if huge:
        vectors[9_999] = [float(np.float32(3e38)), *[-float(np.float32(2e20))] * 31]
    labels = {k: None if k % 5 == 0 else k % 3 for k in vectors}
    bad = [(9001, None, 1), (9002, [float("nan")] * 32, 1), (9003, [None, *[1.0] * 31], 1), (9004, [float("inf")] * 32, 1), (9005, [1.0] * 33, 1), (9006, [], 1)]
    rows = [(k, v, labels[k], "x", 0.5) for k, v in vectors.items()] + [(*b, None, None) for b in bad]
    got = exponion.compressed(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
    assert {r["vec_id"]: (r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in got} == _codes(vectors, labels)


def test_codes_of_few_repeated_and_no_vectors(spark):
    assert exponion.compressed(spark.createDataFrame([], SCHEMA)).collect() == []
    assert exponion.compressed(spark.createDataFrame([(1, None, 1, "", 0.0)], SCHEMA)).collect() == []
    rows = [(1, [0.5] * 16, 1, "", 0.0)] * 3 + [(2, [0.25] * 16, 1, "", 0.0), (None, [9.0] * 16, None, "", 0.0)]
    got = sorted((r["vec_id"] or 99, r["code"], r["error"]) for r in exponion.compressed(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [(1, "00" * 16, 0)] * 3 + [(2, "03" * 16, 0), (99, "04" * 16, 0)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(-40, 40), min_size=3, max_size=3), min_size=1, max_size=30), st.integers(0, 2**32))
def test_bounded_search_equals_full_search(entries, seed):
    rng = np.random.default_rng(seed)
    book, parts = exponion.Codebook(entries), rng.integers(-60, 60, (50, 3))
    for before in (book.start(parts), rng.integers(0, len(entries), 50)):
        index, error = book.nearest(parts, before)
        full = ((parts[:, None] - np.array(entries)[None]) ** 2).sum(2)
        assert (index == full.argmin(1)).all() and (error == full.min(1)).all()


# prefix tries


def _trie(rows: list, every: int = 20) -> list:
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            turns[conv].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [x[2:] for x in sorted(t)] for c, t in turns.items()}
    rebuilt = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        rebuilt[c] = turns.get(c - int(math.fmod(c, every)), [])[:h] + own[h:]
    members, ends = defaultdict(list), defaultdict(list)
    for c, t in rebuilt.items():
        for d in range(len(t) + 1):
            members[tuple(t[:d])].append(c)
        ends[tuple(t)].append(c)
    kids = defaultdict(list)
    for k in members:
        if k:
            kids[k[:-1]].append(k)
    leaves, saved = {}, {}
    for k in sorted(members, key=len, reverse=True):
        words = len([w for w in k[-1][1].replace("\t", " ").replace("\n", " ").split(" ") if w]) if k else 0
        leaves[k] = sum(leaves[x] for x in kids[k]) or 1
        saved[k] = (len(members[k]) - 1) * words + sum(saved[x] for x in kids[k])
    digest = lambda k: hashlib.sha256(",".join(map(str, sorted(ends[k]))).encode()).hexdigest()
    return sorted((min(m), len(k), min(members[k[:-1]]) if k else -(10**9), len(m), len(kids[k]), leaves[k], saved[k], digest(k)) for k, m in members.items())


def _built(df, **options):
    return sorted(tuple(-(10**9) if x is None else x for x in r) for r in prefix_trie.build(df, **options).collect())


TURNS = "conv_id long, turn int, role string, text string, depth long, n_convs string"


def test_trie_of_long_shared_and_awkward_conversations(spark):
    """One conversation over many blocks, copies of a long one, nulls, ties, repeated turns, turnless and negative ones."""
    rng = random.Random(5)
    texts = ["one two", "", None, "three\tfour  five", "x"]
    rows = [(c, t, rng.choice(["user", "assistant", None]), rng.choice(texts)) for c in range(-30, 90) for t in range(rng.choice([0, 1, 2, 5]))]
    rows += [(500, t, "user", f"turn {t % 7}") for t in range(700)]  # over several ranges
    rows += [(c, t, "user", "a copy") for c in (601, 602, 603, 777) for t in range(40)]
    rows += [(None, 1, "user", "nobody"), (700, None, "user", "null turn"), (700, 0, "user", "zero"), (700, 0, "user", "zero"), (700, 0, None, None)]
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], TURNS).repartition(5)
    want = _trie(rows)
    assert _built(df, fan=2, chunk=2) == want
    assert _built(df) == want


def test_trie_of_an_empty_table(spark):
    assert prefix_trie.build(spark.createDataFrame([], TURNS)).collect() == []


def test_trie_of_one_conversation_and_of_equal_ones(spark):
    rows = [(c, t, "user", "the same words") for c in range(20, 40) for t in range(3)]
    assert _built(spark.createDataFrame([(*r, 1, "x") for r in rows], TURNS)) == _trie(rows)
    rows = [(3, 0, "user", "alone")]
    assert _built(spark.createDataFrame([(*r, 1, "x") for r in rows], TURNS)) == _trie(rows)


# line index


def test_line_index_grows_and_shrinks_with_many_keys_a_shard(spark):
    """Three insertions and two deletions with some 10,000 frequent keys in a shard, and more shards in the end, against plain counts."""
    from dialogscope.llm.line_dedup import LineIndex

    line = lambda k: f"line number {k:06d} of a text that is long enough to have a key"
    docs, at = {}, 0
    index = LineIndex(spark, shards=2, keys_a_shard=11_000)

    def frame(ids):
        return spark.createDataFrame([(i, docs[i]) for i in ids], "doc_id long, text string").repartition(4)

    def check():
        held = Counter(x for t in docs.values() for x in set(t.split("\n")))
        last = {}
        for d, t in docs.items():
            last |= {x: max(d, last.get(x, d)) for x in t.split("\n")}
        want = {d: "\n".join(x for x in t.split("\n") if held[x] < 5 or last[x] == d) for d, t in docs.items()}
        assert {r["doc_id"]: r["text"] for r in index.apply(frame(docs)).collect()} == want

    for first, last in ((0, 20_000), (15_000, 42_000), (42_000, 60_000)):
        new = range(at, at + 5)
        docs |= {d: "\n".join(line(k) for k in range(first, last)) for d in new}
        at += 5
        index.insert(frame(new))
    assert index.shards == 5
    check()
    for gone in ([0, 7], [1, 2, 3, 4, 12]):
        index.delete(spark.createDataFrame([(d,) for d in gone], "doc_id long"))
        for d in gone:
            del docs[d]
        check()


# pages


def _page_without_article(rng: random.Random) -> tuple[str, list[str], list[str]]:
    """A page of unmarked divs, the lines of its text, and the others."""
    word = lambda: "".join(rng.choice("abcdefghijklm") for _ in range(rng.randint(2, 9)))
    words = lambda n: " ".join(word() for _ in range(n))
    menu = [words(2) for _ in range(rng.randint(4, 12))]
    links = lambda items: "".join(f"<div><a href='/{word()}'>{x}</a></div>" for x in items)
    body = [words(rng.randint(25, 90)) if rng.random() < 0.75 else words(rng.randint(2, 6)) for _ in range(rng.randint(5, 15))]
    body[0], body[-1] = words(40), words(40)
    tail = [words(3) for _ in range(rng.randint(4, 10))]
    small = words(4)
    html = f"<html><body><div>{small}</div>{links(menu)}" + "".join(f"<{t}>{x}</{t}>" for x in body for t in [rng.choice(["p", "div", "h2"])]) + links(tail) + "</body></html>"
    return html, body, [*menu, *tail, small]


def test_surge_and_dive_on_pages_without_an_article():
    """All lines of text are found, links around them are not; the spans are those of the definition, tried from every line."""
    from dialogscope.llm.html_blocks import SURGE, WINDOW, _spans, lines_of, main_text

    rng = random.Random(6)
    found = wanted = right = 0
    for _ in range(200):
        page, body, others = _page_without_article(rng)
        text = main_text(page)
        got, want = text.split(), " ".join(body).split()
        common = sum((Counter(got) & Counter(want)).values())
        found, wanted, right = found + len(got), wanted + len(want), right + common
        lines = lines_of(page)
        own = [n for _, n, _ in lines] + [0] * WINDOW
        sums = [sum(own[i : i + WINDOW]) for i in range(len(lines))]
        level = min(SURGE, max(sums) / 2)
        # a surge: a line with text whose window reaches the level; its dive: the first later window without any
        runs = {(i, min([j for j in range(i, len(lines)) if not sums[j]], default=len(lines))) for i in range(len(lines)) if own[i] and sums[i] >= level}
        best = max(runs, key=lambda r: (sum(own[r[0] : r[1]]), -r[0]))
        while best[0] and own[best[0] - 1]:
            best = (best[0] - 1, best[1])
        assert _spans(lines) == [best]
    assert right / wanted == 1.0 and right / found > 0.99


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<article><p>" + "A long first article. " * 10 + "</p></article><article><p>Short update.</p></article>", " ".join(["A long first article."] * 10) + " Short update."),
        ("<article><p>One line.</p></article><div>" + "unmarked text " * 30 + "</div>", "One line."),
        ("<article><p title=it's>Hello friends, don't go.</p></article>", "Hello friends, don't go."),
        ("<article><p title=\"a > b\" data-x='<p>'>1 < 2 and 3 > 2</p><!-- no <p> --></article><p", "1 < 2 and 3 > 2"),
        ("<article><p class = 'x' hidden>gone</p><p a=b/c>stays</ p></p></article>", "stays"),
        ("<article><textarea>typed</textarea><p>kept<br/>too</p><script>if (a < b) '</p>'</script> end</article><!-- open", "kept too end"),
        ("<article><a title=\"never closed>all the rest", ""),
    ],
)
def test_short_articles_odd_quotes_and_cut_tags(page, text):
    from dialogscope.llm.html_blocks import main_text

    assert main_text(page) == text


@pytest.mark.parametrize("piece", ["<p ", "<p a='", '<p "', "<", "</", "<!-- ", "<a =", "<p a = ", "<p  / ", "&lt;", "<script>", "<p>", "<b>", "<div><b></i>"])
def test_pages_take_time_in_proportion_to_their_length(piece):
    import time

    from dialogscope.llm.html_blocks import main_text

    began = time.process_time()
    main_text(piece * (1_000_000 // len(piece)))
    main_text("<div>" * 100_000 + "x" + "</div></span>" * 100_000)
    assert time.process_time() - began < 8
