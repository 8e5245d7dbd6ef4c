"""Ranked search, token alignment and URL filters against plain versions."""

import hashlib
import math
import random
import re
from collections import Counter
from itertools import combinations

import numpy as np
import pytest

from introngrid.llm import align, search, urls
from introngrid.llm.queries import tokenizer_path

A, B = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")


def plain_terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_search(docs, items, k):
    bags = [(i, Counter(plain_terms(t))) for i, t in docs]
    total, length = sum(1 for _, b in bags if b), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    wanted = {}
    for i, t in items:
        wanted.setdefault(i, set()).update(plain_terms(t))
    rows = []
    for item, terms in wanted.items():
        scored = []
        for i, b in bags:
            m = 100 - 50 + (50 * sum(b.values()) * total) // max(length, 1)
            s = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * ((10**9 * b[t]) // (1000 * b[t] + 20 * m)) for t in terms if b[t])
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        rows += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scored)[:k])]
    return sorted(rows, key=str)


def some_docs(seed=1, n=120):
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in ("The", "of", "Zug", "éa", "x9", "straße") for b in ("", "1", "ou", "日本", "RE")]
    docs = [(i, " ".join(rng.choices(words, k=rng.randint(1, 60)))) for i in range(n)]
    docs += [(500, None), (501, ""), (502, " ,.;\x00 "), (503, docs[3][1]), (503, docs[3][1]), (None, docs[3][1]), (504, "the-OF_zug " * 3000), (505, docs[4][1])]
    return docs, [(0, "The of, zugRE"), (1, "éa1 x9日本; STRASSE straße1 nowhere"), (2, None), (3, ""), (4, " ".join(words)), (4, "zug x9"), (None, "of zugou"), (5, "nothing here")]


@pytest.mark.parametrize("block", [5_000, 2])
def test_search_equals_plain_scores(spark, monkeypatch, block):
    docs, items = some_docs()
    monkeypatch.setattr(search, "ITEMS", block)
    d = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in docs], "doc_id long, text string, terms string, rank int, item int").repartition(5)
    q = spark.createDataFrame([(i, t, 3) for i, t in items], "item_id long, text string, n int")
    for k in (3, 50):
        got = search.rank_documents(d, q, k=k)
        assert got.columns == ["item_id", "rank", "doc_id", "score"]
        assert sorted((tuple(r) for r in got.collect()), key=str) == plain_search(docs, items, k)


def test_search_of_empty_tables(spark):
    d, q = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert search.rank_documents(d, q).count() == 0
    assert search.rank_documents(q.selectExpr("item_id AS doc_id", "text"), q.limit(0)).count() == 0


def test_masks_of_more_than_64_terms_and_early_end():
    rng = np.random.default_rng(2)
    docs, terms = np.divmod(np.unique(rng.integers(0, 400 * 150, 9000)), 150)
    n, tfs, weights = np.full(400, 30), rng.integers(1, 9, len(docs)), rng.integers(0, 5000, 150)
    block = search.Block(n, docs, terms, tfs, weights, 400, 12000)
    item = np.sort(rng.choice(160, 100, replace=False))
    want = np.zeros(400, np.int64)
    gains = weights[terms] * ((10**9 * tfs) // (1000 * tfs + 20 * (50 + (50 * 30 * 400) // 12000)))
    for d, t, g in zip(docs, terms, gains):
        want[d] += g * (t in item)
    found, scores = block.best(item, 20, 1)
    assert (scores == want[found]).all()
    kept = np.sort(want[want > 0])[::-1][:20]
    assert set(np.flatnonzero(want >= kept[-1])) == set(found.tolist())
    assert set(block.best(item, 20, int(kept[4]))[0].tolist()) == set(np.flatnonzero(want >= kept[4]))


def plain_alignment(docs):
    import sentencepiece
    from tokenizers import Tokenizer

    one, two = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    one.encode_special_tokens = True
    letters = {c: b for b, c in align.byte_letters().items()}
    out, links = [], []
    for i, text in docs:
        a = b = []
        if text:
            a, b = one.encode(" " + text, add_special_tokens=False).ids, two.encode(text)
        bytes_a = [bytes(letters[c] for c in one.id_to_token(x)) for x in a]
        bytes_b = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x..>", p) else p.replace("▁", " ").encode() for p in map(two.id_to_piece, b)]
        if not text or not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
            out.append([i, 0, 0, 0, "", []])
            continue
        ends = [[sum(map(len, x[: k + 1])) for k in range(len(x))] for x in (bytes_a, bytes_b)]
        starts = [[0, *e[:-1]] for e in ends]
        met = [(x, y) for k, x in enumerate(a) for m, y in enumerate(b) if starts[0][k] < ends[1][m] and starts[1][m] < ends[0][k]]
        groups, ga, gb, last = [], 0, 0, sorted(set(ends[0]) & set(ends[1]))
        for stop in last:
            na, nb = ends[0].index(stop) + 1, ends[1].index(stop) + 1
            groups.append(",".join(map(str, a[ga:na])) + "|" + ",".join(map(str, b[gb:nb])))
            ga, gb = na, nb
        out.append([i, len(a), len(b), len(groups), hashlib.sha256(";".join(groups).encode()).hexdigest(), met])
        links += met
    counts = Counter(links)
    most = {}
    for (_, y), n in counts.items():
        most[y] = max(most.get(y, 0), n)
    return sorted(((i, na, nb, g, len(m), sum(counts[x] == most[x[1]] for x in m), sum(counts[x] for x in m), h) for i, na, nb, g, h, m in out), key=str)


TEXTS = [
    None, "", " ", "  ", "a", " a", "a ", "a   ", "\n", "\n\n a\tb", "plain words, and more plain words", "Straße größer naïve façade", "日本語のテキスト と words", "<|endoftext|> is <s> text </s> <unk>",
    "sp ▁ ace", "em\u3000space\u00a0x\x85y", "a\x00b", "e\u0301 ﬁ Å 😀😀 👩‍👩‍👧", "x" * 400, "word " * 300, "don't we'll 12345 67.8e9 ---- !!!", "plain words, and more plain words", "\r\n  indented\r\n    more", "a;\r b{\r\n}\r\r x\r", "x▁ y ▁z", "\n\r {\r", "tail\n \n",
]


@pytest.mark.parametrize("hot", [200_000, 40, 0])
def test_alignment_equals_plain_version(spark, monkeypatch, hot):
    monkeypatch.setattr(align, "HOT", hot)
    docs = [*enumerate(TEXTS), (3, "repeated id"), (None, "no id"), (None, None)]
    df = spark.createDataFrame([(i, t, "p", 1, 2) for i, t in docs], "doc_id long, text string, pairs string, row int, n int").repartition(3)
    got = align.align_tokens(df, A, B)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain_alignment(docs)


def test_alignment_of_an_empty_table(spark):
    assert align.align_tokens(spark.createDataFrame([], "doc_id long, text string"), A, B).count() == 0


def test_gallop_finds_first_places():
    rng = np.random.default_rng(5)
    for size in (1, 2, 7, 1000):
        into = np.unique(rng.integers(0, 5000, size))
        keys = np.sort(rng.integers(-5, into[-1] + 1, 300))
        for near in (np.zeros(300, int), np.full(300, size * 2), rng.integers(-9, size + 9, 300)):
            assert (align.gallop(keys, into, near) == np.searchsorted(into, keys)).all()


def plain_segment(run, counts, total):
    best = None
    for n in range(len(run)):
        for cuts in combinations(range(1, len(run)), n):
            at = [0, *cuts, len(run)]
            parts = [run[a:b] for a, b in zip(at, at[1:])]
            cost = sum(math.log(total / counts[p]) if p in counts else math.log(total / 10) + len(p) * math.log(10) for p in parts)
            if best is None or cost < best[0] - 1e-9:
                best = (cost, parts)
    return best


def test_segmentation_is_the_likeliest_split():
    counts = {"cheap": 30, "pills": 4, "the": 900, "rapist": 2, "therapist": 5, "he": 400, "a": 300, "rap": 3}
    total = float(sum(counts.values()))
    for run in ("cheappills", "therapist", "thea", "zzz", "q", "apillsx", "hethehe"):
        words = [(s, len(w), c) for w, c in counts.items() for s in range(len(run)) if run.startswith(w, s)]
        cost, _ = plain_segment(run, counts, total)
        got = urls.segment(run, words, total)
        assert "".join(got) == run
        assert abs(sum(math.log(total / counts[p]) if p in counts else math.log(total / 10) + len(p) * math.log(10) for p in got) - cost) < 1e-9
    assert urls.segment("cheappills", [(0, 5, 30), (5, 5, 4)], total) == ["cheap", "pills"]


PAGES = [
    (1, "http://www.thewords.example.org/en/12", "<p>the words of the page and more words</p>"), (2, "https://cheappills.example.org/en/3?x=1", "<b class='pills'>cheap</b> things"), (3, "https://m.Spam-Farm.example.com/en/#top", "farm cheap words"),
    (4, "http://a.net/x", None), (5, "http://net/", ""), (6, "http://net", "x"), (7, "http://xnet/en", "x"), (8, "http://b.example.net/en/9", "über straße"), (9, "https://EXAMPLE.com/de/x", "x"), (10, "https://org/fr/", "x"),
    (11, None, "x"), (12, "no scheme/", "x"), (13, "http://", "x"), (14, "x://h?q/net/", "x"), (15, "http://words.page.example.org/the/more/1", "words"), (15, "http://words.page.example.org/the/more/1", "words"), (None, "http://of.example.org/en/%C3%A9/é", "of"),
    (16, "http://" + "words" * 400 + ".example.org/en/" + "a" * 3000, "z " * 5000), (17, "http://a://b/c", "x"),
]


def plain_urls(pages):
    counts = Counter()
    for _, _, html in pages:
        words = re.findall("[A-Za-z\u0080-\U0010ffff]+", re.sub("<[^>]*>", " ", html or ""))
        counts.update(x for w in words if (x := w.lower()).isascii() and len(x) <= 24)
    total = float(sum(counts.values()))
    for s in urls.SEEDS:
        counts[s] = max(counts[s], 1, int(1e-4 * total))
    rows = []
    for i, url, _ in pages:
        rest = (url or "").split("://", 1)[1] if url and "://" in url else ""
        m = re.match(r"([^/?#]*)([^?#]*)", rest)
        host, path = m[1].lower(), m[2]
        fits = [r for r in urls.RULES if (host == (h := r[0].split("/")[0]) or host.endswith("." + h)) and path.startswith(r[0][len(h) :])]
        rule, verdict = max(fits, key=lambda r: len(r[0])) if fits else (None, None)
        words = []
        for run in re.findall(r"[a-z]+|[0-9]+|[^\x00-\x7F]+", (host + path).lower()):
            if run[0].isdigit():
                words.append("0")
            elif run[0].isascii():
                words += urls.segment(run, [(s, n, counts[run[s : s + n]]) for s in range(len(run)) for n in range(1, 25) if s + n <= len(run) and run[s : s + n] in counts], total)
            else:
                words.append(run)
        rows.append((i, host, path, rule, verdict, words, bool(set(words) & set(urls.SEEDS))))
    by = [Counter(w for r in rows if r[6] == c for w in r[5]) for c in (False, True)]
    n = [sum(b.values()) for b in by]
    p = [sum(r[6] == c and bool(r[5]) for r in rows) for c in (False, True)]
    out = []
    for i, host, path, rule, verdict, words, _ in rows:
        score = math.log((p[1] + 1) / (p[0] + 1)) if words else 0.0
        for w in words:
            share = 1000.0 * (by[0][w] + by[1][w]) / sum(n)
            score += math.log((by[1][w] + share) / (n[1] + 1000)) - math.log((by[0][w] + share) / (n[0] + 1000))
        out.append((i, host, path, rule, verdict or ("block" if score > 0 else "allow"), round(score, 4)))
    return sorted(out, key=str)


def test_url_verdicts_equal_plain_version(spark):
    df = spark.createDataFrame([(i, u, h, "w", 1) for i, u, h in PAGES], "page_id long, url string, html string, shape string, n int").repartition(4)
    got = urls.judge_urls(df)
    assert got.columns == ["page_id", "host", "path", "rule", "verdict", "score"]
    rows = sorted(((*r[:5], round(r[5], 4)) for r in got.collect()), key=str)
    assert rows == plain_urls(PAGES)
    found = {r[0]: r for r in rows}
    assert [found[i][4] for i in (1, 2, 3, 4, 8, 9, 10, 11)] == ["allow", "block", "block", "block", "allow", "block", "allow", "allow"]
    assert found[5][3] == "net/" and found[6][3] is None and found[8][3] == "example.net/en/"


def test_urls_of_an_empty_table_and_without_words(spark):
    assert urls.judge_urls(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    got = urls.judge_urls(spark.createDataFrame([(1, None, None), (2, "", "")], "page_id long, url string, html string")).collect()
    assert [tuple(r)[1:5] for r in got] == [("", "", None, "allow")] * 2
