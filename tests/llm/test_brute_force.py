"""Whole operators against slow versions of them, and awkward inputs with their values."""

import math
import random
from collections import Counter, defaultdict
from html.parser import HTMLParser

import numpy as np
import public_tokenizers as P
import pyarrow.parquet as pq
import pytest
import sentencepiece
from pyspark.sql import functions as F

from dialogscope.llm import divergence_rules, html_blocks, kn_quality, line_dedup, wordpiece

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.001"


def frame(spark, texts, langs=None):
    return spark.createDataFrame([(i, t, (langs or {}).get(i, "en"), "s", 0) for i, t in texts], DOCS).repartition(3)


# --- rules


def slow_distance(p, q):
    keys = set(p) | set(q)
    a, b = sum(p.values()), sum(q.values())
    p, q = ({k: x.get(k, 0) / s for k in keys} for x, s in ((p, a), (q, b)))
    kl = lambda x, m: sum(x[k] * math.log2(x[k] / m[k]) for k in keys if x[k] > 0)
    m = {k: (p[k] + q[k]) / 2 for k in keys}
    return math.sqrt(max(0.0, (kl(p, m) + kl(q, m)) / 2))


def slow_class(c):
    for chars, name in (("abcdefghijklmnopqrstuvwxyz", "a"), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "A"), ("0123456789", "0"), (" \t\n\x0b\x0c\r", " "), (".,;:'\"?-()", "."), ("#*$%&|<>", "#")):
        if c in chars:
            return name
    return "other ASCII" if ord(c) < 128 else "Latin" if ord(c) < 0x400 else "other"


def test_verdict_and_distances_equal_brute_force(spark):
    rng = random.Random(3)
    words = ["the", "cat", "sat", "on", "mat", "and", "dog", "ran", "été", "Ωmega", "x1", "big."]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(40, 160)))) for i in range(40)]
    docs += [(100, "QQQ " * 60), (101, " ".join(f"#{k}$" for k in range(80))), (102, "zum " * 3 + " ".join("wort%d" % k for k in range(90)))]
    langs = {i: "de" for i, _ in docs if i % 3 == 0}
    out = {r["doc_id"]: r for r in divergence_rules.judge(frame(spark, docs, langs)).collect()}
    refs = {}
    for lang in ("en", "de"):
        own = [t for i, t in docs if langs.get(i, "en") == lang]
        count = Counter(w.lower() if w.isascii() else "".join(c.lower() if c.isascii() else c for c in w) for t in own for w in t.split())
        top = sorted(count.items(), key=lambda x: (-x[1], x[0].encode()))[:100]
        refs[lang] = dict(top), sum(count.values()), Counter(slow_class(c) for t in own for c in t)
    for i, t in docs:
        top, total, classes = refs[langs.get(i, "en")]
        lower = ["".join(c.lower() if c.isascii() else c for c in w) for w in t.split()]
        r = out[i]
        if len(lower) < 50:
            assert r["base_failed"] and r["word_distance"] is None and not r["kept"]
            continue
        rest = {w: n for w, n in top.items()} | {None: total - sum(top.values())}
        by_word = slow_distance(Counter(w if w in top else None for w in lower), rest)
        by_class = slow_distance(Counter(map(slow_class, t)), classes)
        assert (r["word_distance"], r["class_distance"]) == pytest.approx((by_word, by_class), abs=1e-9)
        assert r["kept"] == (not r["base_failed"] and by_word <= 0.5 and by_class <= 0.32)


# --- word pieces


def test_query_values_equal_greedy_on_whole_texts(spark):
    model = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    entries = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    inner = {x for x in entries if "▁" not in x}
    starts = {x[1:] for x in entries if x.startswith("▁") and len(x) > 1} | {x for x in inner if len(x) == 1}

    def slow(word):
        at = n = 0
        while at < len(word):
            end = next((j for j in range(len(word), at, -1) if word[at:j] in (inner if at else starts)), None)
            if end is None:
                return None
            at, n = end, n + 1
        return n

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = {r["doc_id"]: r for r in wordpiece.token_counts(docs, P.path("piece_bpe_32k.model")).collect()}
    assert len(out) == docs.count()
    for row in docs.collect():
        counts = [slow(w.decode()) for w in (row["text"] or "").encode().split()]
        r = out[row["doc_id"]]
        assert (r["n_words"], r["n_tokens"], r["n_unknown"]) == (len(counts), sum(1 if c is None else c for c in counts), counts.count(None))


# --- line dedup


def test_line_dedup_replaces_columns_of_its_names(spark):
    line = "a line that is long enough to have a key of its own"
    rows = [(i, f"{line}\nown {i}", "old", 7, "x") for i in range(6)] + [(None, line, "old", 7, "x"), (9, None, "old", 7, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_lines string, N_Dropped int, gone string")
    out = line_dedup.dedup(df)
    assert sorted(out.columns) == ["doc_id", "gone", "n_dropped", "n_lines", "text"]
    got = {r["doc_id"]: (r["text"], r["n_lines"], r["n_dropped"], r["gone"]) for r in out.collect()}
    assert got == {**{i: (f"own {i}", 2, 1, "x") for i in range(5)}, 5: (f"{line}\nown 5", 2, 0, "x"), None: (line, 1, 0, "x"), 9: ("", 1, 0, "x")}


# --- Kneser-Ney


class SlowModel:
    """Interpolated modified Kneser-Ney with dictionaries, one text after the other."""

    def __init__(self, by_lang):
        self.vocabulary = {}
        for lang, texts in by_lang.items():
            count = Counter(w for t in texts for w in t.split())
            self.vocabulary[lang] = {w for w, n in count.items() if n >= 2}
        c3 = Counter(tri for lang, texts in by_lang.items() for t in texts for tri in self.trigrams(lang, t) if tri[1] != (lang, "?"))
        c2, c1 = Counter((b, c) for _, b, c in c3), Counter()
        for _, c in c2:
            c1[c] += 1
        c3 = {k: n for k, n in c3.items() if k[0][1] != "?"}
        size = {lang: len(v) + 3 for lang, v in self.vocabulary.items()}
        self.share1, self.rest1 = self.discounted(c1, lambda k: k[0])
        self.p1 = lambda c: self.share1.get(c, 0.0) + self.rest1[c[0]] / size[c[0]]
        share2, self.rest2 = self.discounted(c2, lambda k: k[0])
        self.p2 = {k: x + self.rest2[k[0]] * self.p1(k[1]) for k, x in share2.items()}
        share3, self.rest3 = self.discounted(c3, lambda k: k[:2])
        self.p3 = {k: x + self.rest3[k[:2]] * self.p2[k[1:]] for k, x in share3.items()}

    def trigrams(self, lang, text):
        w = [(lang, "<"), (lang, "<"), *((lang, x if x in self.vocabulary[lang] else "?") for x in text.split()), (lang, ">")]
        return list(zip(w, w[1:], w[2:]))

    @staticmethod
    def discounted(counts, context):
        n = [sum(v == k for v in counts.values()) for k in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.5
        d = {}
        for k, own, up in ((1, n[0], n[1]), (2, n[1], n[2]), (3, n[2], n[3])):
            d[k] = min(max(k - (k + 1) * y * up / own if own else 0.5 * k, 0.1 * k), 0.95 * k)
        total, taken = Counter(), defaultdict(float)
        for k, v in counts.items():
            total[context(k)] += v
            taken[context(k)] += d[min(v, 3)]
        return {k: (v - d[min(v, 3)]) / total[context(k)] for k, v in counts.items()}, {k: taken[k] / total[k] for k in total}

    def perplexity(self, lang, text):
        score = 0.0
        tri = self.trigrams(lang, text)
        for a, b, c in tri:
            if b[1] == "?":
                p = self.p1(c)
            elif (a, b, c) in self.p3:
                p = self.p3[a, b, c]
            else:
                p = self.rest3.get((a, b), 1.0) * self.p2.get((b, c), self.rest2.get(b, 1.0) * self.p1(c))
            score += math.log10(p) - (math.log10(kn_quality.OPEN_WORDS) if c[1] == "?" else 0)
        return 10 ** (-score / len(tri))


def test_perplexities_equal_a_slow_model(spark):
    rng = random.Random(12)
    docs, langs = [], {}
    for k, lang in enumerate(("en", "fr")):
        for i in range(40):
            docs.append((1000 * k + i, " ".join(f"{lang}{min(rng.randint(0, 30), rng.randint(0, 60))}" for _ in range(rng.randint(0, 90)))))
            langs[1000 * k + i] = lang
    docs += [(5000, None), (5001, ""), (5002, "never seen words here"), (5003, "en1 en2 en1 en2 nothing en1 en2")]
    labels = spark.createDataFrame([(i, 1, 0) for i, _ in docs if i < 5000], "doc_id long, quality int, toxic int")
    df = frame(spark, docs, langs)
    out = {r["doc_id"]: r for r in kn_quality.classify(df, labels).collect()}
    held = {r["doc_id"] for r in kn_quality.trusted(df, labels).where("held_out").collect()}
    by_lang = {lang: [t for i, t in docs if langs.get(i) == lang and i not in held] for lang in ("en", "fr")}
    slow = SlowModel(by_lang)
    assert len(out) == len(docs)
    for i, t in docs:
        assert out[i]["perplexity"] == pytest.approx(slow.perplexity(langs.get(i, "en"), t or ""), rel=1e-4), i
        assert out[i]["n_tokens"] == len((t or "").split()) + 1


# --- pages


class Tree(HTMLParser):
    """The text of an article as a tree walk gives it: blocks in order, boilerplate left out by element, role and class."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack, self.blocks, self.words, self.raw = [], [], [], None

    def end_block(self):
        text = " ".join("".join(self.words).split())
        self.blocks += [text] if text else []
        self.words = []

    def handle_starttag(self, tag, attrs):
        if self.stack and self.stack[-1][0] in html_blocks.CLOSES.get(tag, ()):
            self.handle_endtag(self.stack[-1][0])
        if tag in html_blocks.BLOCKS and self.inside():
            self.end_block()
        if tag in html_blocks.VOID:
            return
        names = {w for k, v in attrs if k in ("class", "id") for w in (v or "").lower().split()}
        dropped = tag in html_blocks.DROPPED or bool(names & html_blocks.CLASSES) or tag == "header" and not self.in_article()
        self.stack.append((tag, dropped))

    def handle_endtag(self, tag):
        if tag not in [t for t, _ in self.stack]:
            return
        while self.stack:
            name = self.stack[-1][0]
            if name in html_blocks.BLOCKS and self.inside():
                self.end_block()
            self.stack.pop()
            if name == tag:
                break

    def in_article(self):
        return any(t in ("article", "main") for t, _ in self.stack)

    def inside(self):
        return self.in_article() and not any(d for _, d in self.stack)

    def handle_data(self, data):
        if self.inside():
            self.words.append(data)


def slow_text(page):
    tree = Tree()
    tree.feed(page)
    tree.close()
    tree.end_block()
    return " ".join(tree.blocks)


def test_pages_equal_a_tree_walk(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    out = {r["page_id"]: r["text"] for r in html_blocks.extract(pages).collect()}
    for row in pages.collect():
        assert out[row["page_id"]] == slow_text(row["html"] or "")


def test_generated_pages_equal_a_tree_walk():
    rng = random.Random(6)
    sentence = lambda: " ".join("word%d" % rng.randint(0, 99) for _ in range(rng.randint(12, 40))) + " &amp; more."
    for _ in range(150):
        inner = ""
        for _ in range(rng.randint(3, 9)):
            inner += rng.choice(
                [
                    f"<p>{sentence()}</p>", f"<p>{sentence()}<br>{sentence()}", f"<h2>Short {rng.randint(0, 9)}</h2><p>{sentence()}</p>", f"<div class='ad'>{sentence()}</div>",
                    f"<ul><li><a href=/a>One link</a><li><a href=/b>Other &lt;link&gt;</a></ul><p>{sentence()}</p>", f"<aside>{sentence()}</aside>", f"<form><input>{sentence()}</form>",
                    f"<p class='social-history'>{sentence()}</p>", f"<table><tr><td>{sentence()}<td>cell</table>", "<script>if (a < b) { '</p>' }</script>", f"<blockquote>{sentence()}</blockquote>",
                ]
            )
        inner = f"<p>{sentence()}</p>{inner}<p>{sentence()}</p>"
        side = f"<nav><ul><li><a href=/>Home</a><li><a href=/x>Away</a></ul></nav><div class=sidebar>{sentence()}</div>"
        comments = f"<section class='comments'><p>{sentence()}</p></section>"
        page = f"<html><head><title>T</title></head><body><header>{sentence()}</header>{side}<article>{inner}</article>{comments}<footer>{sentence()}</footer></body></html>"
        assert html_blocks.main_text(page) == slow_text(page), page


def test_main_text_of_an_article_in_two_parts():
    a, b = ("The %s paragraph goes on for long enough, with what it says, to be the text of this page by itself." % x for x in ("first", "second"))
    assert html_blocks.main_text(f"<article><p>{a}</article><p>between</p><article><p>{b}</article>") == f"{a} {b}"
    assert html_blocks.main_text(f"<article><p class='social-history'>{a}</p><p class='ad-slot'>{b}</p><p>{b}</p></article>") == f"{a} {b}"
    long = "".join(f"<p>{k} {a}</p>" for k in range(4000))
    assert html_blocks.main_text(f"<article>{long}</article>") == " ".join(f"{k} {a}" for k in range(4000))
