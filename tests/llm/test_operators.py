"""Small cases and brute-force versions for the corpus operators."""

import binascii
import hashlib
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from introngrid.llm import exact, langid, mix, packing, pq, simhash, substring, tokenbin, tokens, warc
from introngrid.llm.queries import tokenizer_path

DOCS = "doc_id long, text string, lang string, source string, size string, taken string, kept boolean, uid string"


def rng_text(rng, n, words=40):
    return " ".join(f"w{rng.integers(words)}" for _ in range(n))


def docs(spark, rows):
    """Rows (doc_id, text, lang, source) with more columns whose names clash with the operators' own."""
    return spark.createDataFrame([(*r, "x", "y", None, "z") for r in rows], DOCS).repartition(3)


def corpus(rng, n=120):
    rows = [(i, rng_text(rng, int(rng.integers(0, 90))), "en", f"s{i % 5}") for i in range(n)]
    passage = rng_text(rng, 60, 5000)
    rows += [(1000 + i, f"{rng_text(rng, 5, 9000)} {passage} {rng_text(rng, 5, 9000)}", "en", "s0") for i in range(12)]
    rows += [(2000 + i, "same text here", "en", "s1") for i in range(9)]
    rows += [(3000, None, None, None), (3001, "", "en", ""), (3002, " \t\n", "en", "s2"), (3003, "a " * 300, "en", "s3"), (3003, "a " * 300, "en", "s3")]
    rows += [(3004, rng_text(rng, 9000, 300), "en", "s0"), (None, "text without id", "en", "s4"), (3005, "café 　naïve <|endoftext|> x", "fr", "\U0001f600")]
    return rows


@pytest.fixture(scope="module")
def rows():
    return corpus(np.random.default_rng(3))


@pytest.fixture(scope="module")
def table(spark, rows):
    return docs(spark, rows).cache()


def words(text):
    return (text or "").encode().split()


def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_empty_tables(spark):
    e = empty(spark)
    path = tokenizer_path("word_bpe_49k.json")
    assert mix.mix_sizes(e).count() == 0 and mix.mix_documents(e).count() == 0
    assert tokens.count_tokens(e, tokenizer_path("byte_bpe_50k.json")).count() == 0
    assert substring.remove_repeats(e).count() == 0
    assert simhash.simhash_groups(e).count() == 0 and simhash.drop_near_copies(e).count() == 0
    assert exact.exact_groups(e).count() == 0 and exact.drop_exact_copies(e).count() == 0
    assert langid.predict_languages(e).count() == 0
    assert packing.pack_documents(e, path).count() == 0
    assert tokenbin.packed_matrices(e, path).count() == 0
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.archive_round_trip(pages).count() == 0
    assert pq.embedding_groups(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_mix_against_brute_force(table, rows):
    got = mix.mix_sizes(table).collect()
    assert len(got) == len(rows)
    size, order = {}, sorted({r[3] for r in rows if r[3] is not None}) + [None]
    for _, text, _, source in rows:
        size[source] = size.get(source, 0) + len(words(text))
    weight = {s: 1 + i % 3 for i, s in enumerate(order)}
    target, open_, left = {}, set(order), sum(size.values())
    while True:  # reshare what is over the caps until none is
        level = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if weight[s] * level > 3 * size[s]]
        if not over:
            break
        for s in over:
            target[s] = 3.0 * size[s]
            left -= target[s]
            open_.remove(s)
    target |= {s: weight[s] * level for s in open_}
    longest, taken = {}, {}
    for r in got:
        assert r["target"] == pytest.approx(target[r["source"]])
        assert r["source_size"] == size[r["source"]]
        assert 0 <= r["taken"] <= 3 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0)
        longest[r["source"]] = max(longest.get(r["source"], 0), r["size"])
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    for s, t in taken.items():
        assert abs(t - target[s]) <= max(longest[s], 1)
    again = mix.mix_sizes(table.repartition(7)).collect()
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["taken"])
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_small_sources_come_near_their_targets(spark):
    """Sources of eight documents, some of them long: words taken lie within the shortest document or the slack of the target."""
    rng = np.random.default_rng(8)
    rows = [(100 * s + i, rng_text(rng, int(rng.integers(20, 200)) * (5 if i == 0 else 1)), "en", f"small{s}") for s in range(9) for i in range(8)]
    rows += [(5000, "alone " * 70, "en", "one"), (5001, "pair " * 40, "en", "two"), (5002, "pair " * 90, "en", "two"), (5002, "pair " * 90, "en", "two"), (None, "n " * 30, "en", "two")]
    got = mix.mix_sizes(docs(spark, rows)).collect()
    assert len(got) == len(rows) and all(r["taken"] <= 3 * r["size"] and r["taken"] % r["size"] == 0 for r in got)
    for source in {r["source"] for r in got} - {"one", "two"}:
        own = [r for r in got if r["source"] == source]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= max(min(r["size"] for r in own), mix.NEAR * own[0]["target"])
    for source in ("one", "two"):
        own = [r for r in got if r["source"] == source]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= max(r["size"] for r in own)


@pytest.mark.parametrize("n", [0, 1, 7, 10, 14])
@pytest.mark.parametrize("slack", [0.0, 15.0])
def test_flips_against_all_combinations(spark, n, slack):
    rng = np.random.default_rng(n)
    sizes = sorted(rng.integers(1, 400, n).tolist(), reverse=True)
    traders = [(-float(a), i, i, a, float(a if rng.random() < 0.5 else -a)) for i, a in enumerate(sizes)]
    table = spark.createDataFrame([(123.0, slack, traders)], "left double, slack double, traders array<struct<order double, h long, doc_id long, size long, d double>>")
    got = table.select(mix._flips(F.col("left"), F.col("slack"), F.col("traders"), 5).alias("f")).first()["f"]
    left, many, cut = 123.0, 0, max(0, n - mix.SHORTEST)
    for t in traders[:cut]:
        if abs(left) > slack and abs(left - t[4]) < abs(left):
            left, many = left - t[4], many + 1
    sets = [[t[4] for k, t in enumerate(traders[cut:]) if m >> k & 1] for m in range(1 << min(n, mix.SHORTEST))]
    best = min((max(abs(left - sum(x)) - slack, 0.0), many + len(x)) for x in sets)
    assert (max(abs(123.0 - sum(f["d"] for f in got)) - slack, 0.0), len(got)) == (pytest.approx(best[0]), best[1])


def test_mix_documents_repeats_rows(table):
    plan = {}
    for r in mix.mix_sizes(table).collect():
        plan[r["doc_id"]] = plan.get(r["doc_id"], 0) + r["copies"]
    out = mix.mix_documents(table)
    assert out.columns == table.columns
    assert {r["doc_id"]: r["count"] for r in out.groupBy("doc_id").count().collect()} == {k: v for k, v in plan.items() if v}


def test_fold_keeps_expectation(spark):
    """Over many seeds, each document is taken near its share of times, whatever its length."""
    rows = [(i, "a " * (1 + 7 * (i % 4)), "en", "p" if i % 3 else "q") for i in range(18)]
    table = docs(spark, rows).cache()
    total, share = {}, {}
    for seed in range(24):
        for r in mix.mix_sizes(table, seed=seed).collect():
            total[r["doc_id"]] = total.get(r["doc_id"], 0) + r["copies"]
            share[r["doc_id"]] = r["target"] / r["source_size"]
    assert all(abs(total[k] / 24 - share[k]) < 0.45 for k in total)


def test_token_counts(table, rows):
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    for r in tokens.count_tokens(table, path, limit=50).collect():
        texts = [t or "" for d, t, *_ in rows if d == r["doc_id"]]
        n = len(lib.encode(texts[0], add_special_tokens=False).ids)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(texts[0].encode()), n, n > 50)


@pytest.mark.parametrize("text", ["", "a<|endoftext|>b", "  x  \n\n y\t z ", "don't 're 12,3 \x1c\x85q\xa0 w", "　　a  ", "ΣΑΣ İx ŉ ſt", "x<|startoftext|>y's I'LL", "é 日本語 ǅ", "a\r\nb  c"])
def test_odd_texts_like_the_library(text):
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    assert tokens.TokenCounter(path).count(text) == len(Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids)
    path = tokenizer_path("word_bpe_49k.json")
    ids, n = tokens.WordIds(path).encode([text.encode(), b"next one"])
    lib = Tokenizer.from_file(path)
    want = [lib.encode(t, add_special_tokens=False).ids for t in (text, "next one")]
    assert ids.tolist() == want[0] + want[1] and n.tolist() == [len(w) for w in want]


def test_whole_tokens_are_single_tokens():
    counter = tokens.TokenCounter(tokenizer_path("byte_bpe_50k.json"))
    some = sorted(counter.whole)[::997]
    assert len(counter.whole) > 40_000 and all(len(counter.tokenizer.encode(x, add_special_tokens=False).ids) == 1 for x in some)


def test_warc_round_trip(spark):
    html = ["<p>" + "x" * 200, None, "short", "short", "<p>" + "x" * 200, "café " * 40, "café " * 40, "a\r\n\r\nb" * 30]
    pages = spark.createDataFrame([(10 - i, f"http://h/{i}\r\nX: y", h, "clash") for i, h in enumerate(html)], "page_id long, url string, html string, digest string").repartition(3)
    index = warc.write_archives(pages)
    got = {r["page_id"]: r for r in warc.read_records(index).collect()}
    for i, h in enumerate(html):
        raw, r = (h or "").encode(), got[10 - i]
        same = [10 - j for j, x in enumerate(html) if (x or "") == (h or "")]
        first = min(same) if len(raw) >= 100 else 10 - i
        assert (r["payload_bytes"], r["payload_digest"], r["valid"]) == (len(raw), hashlib.sha256(raw).hexdigest(), True)
        assert (r["record_type"], r["refers_to"]) == (("response", None) if first == 10 - i else ("revisit", first))
        assert r["payload"] == (bytearray(raw) if first == 10 - i else None)
    one = warc.read_records(index.where("page_id = 5")).collect()
    assert [r["page_id"] for r in one] == [5]


def test_warc_repeated_page_ids(spark):
    """Rows that repeat the smallest page_id of a payload are all responses; others name that id, however often it occurs."""
    long, other = "p" * 200, "q" * 150
    rows = [(3, "u", long), (3, "u", long), (5, "v", long), (5, "v", long), (3, "w", other), (9, "w", "short"), (9, "w", "short")]
    got = warc.archive_round_trip(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    told = sorted((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"] or 0) for r in got)
    assert told == sorted([(3, 200, "response", 0)] * 2 + [(5, 200, "revisit", 3)] * 2 + [(3, 150, "response", 0)] + [(9, 5, "response", 0)] * 2)
    assert all(r["valid"] for r in got)


def brute_removed(texts, window):
    seen = {}
    for t in texts:
        w = words(t)
        for i in range(len(w) - window + 1):
            k = b" ".join(w[i : i + window])
            seen[k] = seen.get(k, 0) + 1
    out = []
    for t in texts:
        w = words(t)
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[b" ".join(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        out.append((len(w), len(gone), hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest()))
    return out


@pytest.mark.parametrize("window", [35, 12, 3])
def test_substring_against_brute_force(table, rows, window):
    want = sorted((d is None, d or 0, *x) for (d, *_), x in zip(rows, brute_removed([r[1] for r in rows], window), strict=True))
    got = substring.remove_repeats(table, window=window).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got) == want


def test_substring_runs_and_periods(spark):
    texts = ["a " * 40, "a " * 50 + "b", "x y " * 30, "y x " * 25, "p " + "q r s " * 20, " ".join(map(str, range(80))), " ".join(map(str, range(20, 70)))]
    table = docs(spark, [(i, t, "en", "s") for i, t in enumerate(texts)])
    want = {i: x for i, x in enumerate(brute_removed(texts, 35))}
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring.remove_repeats(table).collect()} == want


def brute_print(text, width):
    w = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()).split()
    hashes = [xxhash.xxh64_intdigest(b" ".join(w[i : i + width]), 42) for i in range(max(1, len(w) - width + 1))] if w else []
    return sum(1 << b for b in range(64) if hashes and 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_against_brute_force(table, rows):
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["fingerprint"], r["component_id"]) for r in simhash.simhash_groups(table).collect())
    prints = np.array([brute_print(r[1], 4) for r in rows], dtype=np.uint64)
    low = np.arange(len(rows))
    near = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 4
    while True:
        new = np.where(near, low[None, :], len(rows)).min(1)
        if (new == low).all():
            break
        low = new
    ids = [r[0] for r in rows]
    name = {c: min((ids[i] for i in np.flatnonzero(low == c) if ids[i] is not None), default=None) for c in set(low.tolist())}
    assert got == sorted((i is None, i or 0, f"{int(p):016x}", name[c]) for i, p, c in zip(ids, prints, low.tolist(), strict=True))


@pytest.mark.parametrize("radius", [1, 3, 4, 6])
def test_covering_masks_catch_every_pair(radius):
    rng = np.random.default_rng(radius)
    masks = np.array(simhash.covering_masks(radius), dtype=np.int64).view(np.uint64)
    assert len(masks) == 2 ** (radius + 1) - 1
    for _ in range(3000):
        bits = rng.choice(64, size=radius, replace=False)
        diff = np.bitwise_or.reduce(np.uint64(1) << bits.astype(np.uint64))
        assert (masks & diff == 0).any()


def test_links_of_large_buckets(spark):
    """One bucket of thousands of fingerprints in two clusters, and a chain: all links are found whatever the sort order."""
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 3, dtype=np.uint64)
    prints = set()
    for b, n in zip(base[:2].tolist(), (1500, 700), strict=True):
        for _ in range(n):
            prints.add(b ^ int(sum(1 << int(i) for i in rng.choice(30, size=rng.integers(0, 4), replace=False))))
    chain = int(base[2])
    for step in range(12):
        prints.add(chain)
        chain ^= 0b1111 << (4 * step)
    prints = np.array(sorted(prints), dtype=np.uint64)
    table = spark.createDataFrame([(int(p),) for p in prints.view(np.int64)], "fp long").repartition(5)
    got = {np.uint64(r["fp"] & (2**64 - 1)): r["comp"] for r in simhash.link_fingerprints(table).collect()}
    low = np.arange(len(prints))
    near = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 4
    while True:
        new = np.array([low[n].min() for n in near])
        if (new == low).all():
            break
        low = new
    label = [got[p] for p in prints]
    assert len({(a, b) for a, b in zip(low.tolist(), label, strict=True)}) == len(set(low.tolist())) == len(set(label))


def test_bucket_pairs_whatever_the_batches():
    """Small buckets give all their likely pairs; of the others every row is listed, wherever batches and partitions cut them."""
    import pandas as pd

    rng = np.random.default_rng(4)
    size = [1, 2, 9, 10, 3, 30, 1, 8, 100, 2]
    key = np.repeat(np.arange(len(size)), size)
    n = len(key)
    fp = np.where(rng.random(n) < 0.7, 5, rng.integers(0, 2**47, n))
    comp = np.where(key == 8, 7, np.where(rng.random(n) < 0.5, 0, rng.integers(1, 3, n)))  # the bucket of 100 is one component
    rows = pd.DataFrame({"bucket": key, "node": np.arange(n) + 1000, "fp": fp, "more": fp, "comp": comp})
    apart = lambda i, j: comp[i] != comp[j] or comp[i] == 0
    near = lambda i, j: bin((fp[i] ^ fp[j])).count("1") * 2 <= simhash.SKETCH_RADIUS
    for step in (1, 3, 7, 20, 50, n):
        out = pd.concat(simhash._bucket_pairs(rows.iloc[i : i + step] for i in range(0, n, step)))
        pairs, members = out[out.kind == 0], out[out.kind == 1]
        assert not members.duplicated(["a", "b"]).any()
        listed = set(members["b"] - 1000)
        assert all(len(set(np.flatnonzero(key == k)) & listed) in (0, m) for k, m in enumerate(size))
        assert all(set(np.flatnonzero(key == k)) <= listed for k, m in enumerate(size) if m > simhash.SMALL and k != 8 or k in (0, len(size) - 1))
        assert step < n or not set(np.flatnonzero(key == 8)) & listed
        got = set(zip(pairs["a"] - 1000, pairs["b"] - 1000, strict=True))
        assert all(key[i] == key[j] and near(i, j) and apart(i, j) for i, j in got)
        assert got >= {(i, j) for i in range(n) for j in range(i + 1, n) if key[i] == key[j] and i not in listed and near(i, j) and apart(i, j)}


def test_near_copies_leave_one(spark):
    rng = np.random.default_rng(9)
    base = [f"v{rng.integers(3000)}" for _ in range(400)]
    near = base.copy()
    near[200] = "changed"
    table = docs(spark, [(5, " ".join(base), "en", "s"), (3, " ".join(near), "en", "s"), (9, rng_text(rng, 300, 3000), "en", "s"), (None, "alone", "en", "s")])
    out = simhash.drop_near_copies(table, width=5)
    assert out.columns == table.columns and sorted(r["doc_id"] or 0 for r in out.collect()) == [0, 3, 9]


def test_exact_against_brute_force(table, rows):
    weak = lambda c: F.pmod(F.xxhash64(c), F.lit(5))
    want = []
    for d, text, *_ in rows:
        own = [r[0] for r in rows if (r[1] or "") == (text or "")]
        keep = max((x for x in own if x is not None), default=None)
        want.append((d is None, d or 0, keep, len(own), d == keep, hashlib.sha256((text or "").encode()).hexdigest()))
    for digest in (F.xxhash64, weak):  # the weak one makes nearly every pair of chunks clash
        got = [(r["doc_id"] is None, r["doc_id"] or 0, r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in exact.exact_groups(table, digest=digest).collect()]
        assert sorted(got) == sorted(want)


def test_exact_keeps_one_of_each(table, rows):
    out = exact.drop_exact_copies(table)
    texts = [r["text"] or "" for r in out.collect()]
    assert out.columns == table.columns and sorted(texts) == sorted({r[1] or "" for r in rows})


def test_chunks_join_to_the_text(spark):
    text = rng_text(np.random.default_rng(1), 5000, 900) + "\n" + "z" * 9000
    parts = spark.createDataFrame([(text,)], "t string").select(exact.chunks_of(F.col("t"))).first()[0]
    assert "".join(parts) == text and len(parts) > 3 and max(map(len, parts)) <= 4096


def test_languages(spark):
    rng = np.random.default_rng(2)
    vocab = {"aa": ["the", "and", "with", "shall"], "bb": ["der", "und", "nicht", "ein"], "cc": ["que", "los", "por", "una"]}
    rows = [(i, " ".join(rng.choice(vocab[k], 12)), k, "s") for i, k in enumerate(list(vocab) * 60)]
    rows += [(900, None, "aa", "s"), (901, "12 34 !!", "bb", "s"), (902, "", "cc", "s"), (903, "the and with", None, "s"), (None, "que los por", "cc", "s"), (904, "und " * 30_000, "bb", "s")]
    got = {r["doc_id"]: r for r in langid.predict_languages(docs(spark, rows)).collect()}
    for d, _, lang, _ in rows[:180]:
        assert got[d]["held_out"] == (binascii.crc32(str(d).encode()) % 5 == 0) and got[d]["lang_pred"] == lang and 0 <= got[d]["score"] <= 1
    assert [got[d]["lang_pred"] for d in (900, 901, 902, 903, None, 904)] == ["und", "und", "und", "aa", "cc", "bb"]
    alone = langid.predict_languages(docs(spark, [(1, "no labels at all", None, "s")])).first()
    assert (alone["lang_pred"], alone["score"]) == ("und", 0.0)


def test_language_table_is_the_kernel_model():
    """The collapsed table scores like plain kernel values of n-gram sets times Nyström ridge coefficients."""
    rng = np.random.default_rng(12)
    texts = [" ".join("".join(rng.choice(list(letters), 5)) for _ in range(12)) for letters in ("abcdé", "defgh", "ghiж字") for _ in range(20)]
    labels = [x for x in "pqr" for _ in range(20)]
    sets = [set(langid._places(t).tolist()) for t in texts]
    kernel = lambda a, b: len(a & b) / (len(a) * len(b)) ** 0.5
    marks = [sets[i] for i in np.sort(np.random.default_rng(11).permutation(60)[: langid.LANDMARKS])]
    k_zz = np.array([[kernel(a, b) for b in marks] for a in marks])
    k_xz = np.array([[kernel(a, b) for b in marks] for a in sets])
    values, vectors = np.linalg.eigh(k_zz)
    good = values > 1e-6 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])
    y = np.where(np.array(labels)[:, None] == np.array(["p", "q", "r"])[None, :], 1.0, -1.0)
    phi = k_xz @ root  # classes are equally large, so all rows weigh 1
    alpha = root @ np.linalg.solve(phi.T @ phi + langid.RIDGE * 60 * np.eye(phi.shape[1]), phi.T @ y)
    model = langid.Classifier([np.packbits(langid.presence([t])[0] > 0).tobytes() for t in texts], labels)
    new = ["abc éda " * 9, "gh fed", "字ж gi", "x", texts[3] + texts[45]]
    want = np.array([[kernel(set(langid._places(t).tolist()), m) for m in marks] for t in new]) @ alpha
    assert np.allclose(langid.presence(new) @ model.table, want, atol=2e-3)
    pred, score = model.predict(new)
    assert pred == [model.languages[i] for i in want.argmax(1)]
    top = np.sort(want, axis=1)
    assert np.allclose(score, np.clip((top[:, -1] - top[:, -2]) / 2, 0, 1), atol=2e-3)


def test_language_sample_takes_alike_many_of_each(spark):
    """A language of one row among hundreds is learned; beyond `sample` languages the commonest are; repeated rows count once."""
    rows = [(i, f"common words {i} here", "aa", "s") for i in range(300)] + [(1000 + i, f"zz{i} qq{i}", f"rare{i:02d}", "s") for i in range(20)]
    rows += [(7000, "same row again", "bb", "s")] * 40 + [(None, None, "cc", "s")]
    table = docs(spark, rows)
    model = langid.fit(table.select("doc_id", "text", "lang"), sample=44)
    assert set(model.languages) == {"aa", "bb", *(f"rare{i:02d}" for i in range(20))}
    few = langid.fit(table.select("doc_id", "text", "lang"), sample=5)
    assert set(few.languages) == {"aa", "bb", "rare00", "rare01", "rare02"}
    got = langid.predict_languages(docs(spark, [(i, f"word{i} text{i}", f"l{i}", "s") for i in range(60)]), sample=10).collect()
    assert len(got) == 60 and len({r["lang_pred"] for r in got}) <= 10


@pytest.mark.parametrize("n", [1, 31, 32, 33, 2047, 2048, 2049, 5000])
def test_cut_lengths(n):
    parts = packing.cut_lengths(n)
    assert sum(parts) == n and min(parts) > 0 and max(parts) <= 2048


def test_packing_is_lossless(table, rows):
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    ids = {d: np.array([*lib.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4") for d, t, *_ in rows}
    got = packing.pack_documents(table, path).collect()
    used, total = {}, {}
    for r in got:
        own = ids[r["doc_id"]]
        assert r["doc_tokens"] == len(own) and zlib.crc32(own[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"]
        used.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        total[r["doc_id"]] = total.get(r["doc_id"], 0) + r["length"]
    copies = {d: [r[0] for r in rows].count(d) for d in ids}
    assert total == {d: len(x) * copies[d] for d, x in ids.items()}
    pad = 0
    for parts in used.values():
        parts.sort()
        assert [o for o, _ in parts] == np.cumsum([0, *[n for _, n in parts[:-1]]]).tolist()
        fill = sum(n for _, n in parts)
        assert fill <= 2048
        pad += 2048 - fill
    assert pad < 2048 and sorted(used) == list(range(len(used)))


@pytest.mark.parametrize("share", [50, 50_000])
def test_harmonic_classes_fill_their_bins(spark, monkeypatch, share):
    """Random lengths: bins of a class hold k of its pieces, fillers close the gaps, and every id has one place, whatever the shares."""
    rng, capacity = np.random.default_rng(17), 64
    monkeypatch.setattr(packing, "SHARE", share)
    rows = []
    for uid, n in enumerate([*rng.integers(1, 65, 900).tolist(), *[64] * 30, *[1] * 40, *[33] * 100]):
        ids = rng.integers(0, 50_000, n).astype("<u4")
        rows.append((uid % 700, 0, n, zlib.crc32(ids.tobytes()), n, bytearray(ids.tobytes()), uid))
    table = spark.createDataFrame(rows, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary, uid long").repartition(5)
    got = packing.pack(packing.materialize(table, "test"), capacity, with_ids=True).collect()
    used = {}
    for r in got:
        assert zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"]
        used.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in used.values():
        parts.sort()
        assert [o for o, _ in parts] == np.cumsum([0, *[n for _, n in parts[:-1]]]).tolist()
    fill = sorted(sum(n for _, n in parts) for parts in used.values())
    assert sorted(used) == list(range(len(used))) and fill[1:] == [64] * (len(fill) - 1) and fill[0] <= 64
    whole = {}
    for r in got:
        whole.setdefault(r["doc_id"], []).append(bytes(r["ids"]))
    assert {d: sorted(b"".join(x)) for d, x in whole.items()} == {d: sorted(b"".join(bytes(r[5]) for r in rows if r[0] == d)) for d in whole}
    uncut = sum(r["length"] == r["doc_tokens"] for r in got)
    assert len(got) < 1.8 * len(rows) and uncut > len(rows) / 3


def test_filler_steps_leave_no_gap():
    assert packing.filler_steps([], 0, 64) == 0
    assert packing.filler_steps([(1, 0, 5), (1, 700, 5)], 10 * 64, 64) == 0  # full already
    assert packing.filler_steps([(1, 0, 5), (1, 700, 5)], 10 * 40, 64) == 1  # five bins of 64 fit into 400 tokens
    assert packing.filler_steps([(2, 3, 9)], 9 * 22, 64) == 4


def test_matrices_hold_all_ids(table, rows):
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    ids = {d: [*lib.encode(t or "", add_special_tokens=False).ids, 1] for d, t, *_ in rows}
    n = 0
    for r in tokenbin.packed_matrices(table, path, capacity=256, share=4000).collect():
        line = np.frombuffer(r["ids"], dtype="<u2").tolist()
        assert r["valid"] and len(line) == 256 and line[r["n_tokens"] :] == [0] * (256 - r["n_tokens"]) and r["cu_seqlens"][0] == 0 and r["cu_seqlens"][-1] == r["n_tokens"] and r["position_resets"] == r["cu_seqlens"][:-1]
        for a, b, d, s in zip(r["cu_seqlens"], r["cu_seqlens"][1:], r["doc_ids"], r["doc_starts"], strict=False):
            assert line[a:b] == ids[d][s : s + b - a]
        n += r["n_tokens"]
    assert n == sum(len(ids[r[0]]) for r in rows)


def test_best_fit_against_plain_search():
    rng = np.random.default_rng(8)
    lengths = rng.integers(1, 101, 400).tolist()
    bins, offsets = tokenbin.best_fit(lengths, 100)
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [(r, i) for i, r in enumerate(rooms) if r >= n]
        if fits:
            rooms[min(fits)[1]] -= n
        else:
            rooms.append(100 - n)
    assert len(set(bins)) == len(rooms) and max(o + n for o, n in zip(offsets, lengths, strict=True)) <= 100


def vectors(rng):
    centres = rng.normal(size=(12, 16))
    v = [c + 0.5 * rng.normal(size=16) for c in centres for _ in range(40)]
    v += [v[i] + 0.05 * rng.normal(size=16) for i in range(0, 480, 6)]
    v += [v[7]] * 30 + [3 * v[8]]
    return np.array(v, dtype=np.float32)


def test_embeddings_against_brute_force(spark):
    v = vectors(np.random.default_rng(4))
    bad = [(9000, None), (9001, [0.0] * 16), (9002, [float("nan")] + [1.0] * 15), (9003, [float("inf")] + [1.0] * 15), (9004, [None] + [1.0] * 15)]
    rows = [(i, x.tolist(), 1) for i, x in enumerate(v)] + [(i, x, None) for i, x in bad]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, component_id int").repartition(4)
    got = {r["vec_id"]: r for r in pq.embedding_groups(table).collect()}
    u = v.astype(float) / np.linalg.norm(v.astype(float), axis=1, keepdims=True)
    link = u @ u.T >= 0.95
    np.fill_diagonal(link, False)
    found = np.array([got[i]["n_links"] for i in range(len(v))])
    assert (found <= link.sum(1)).all() and found.sum() >= 0.9 * link.sum()
    low = np.arange(len(v))
    while True:
        new = np.minimum(low, np.where(link, low[None, :], len(v)).min(1))
        if (new == low).all():
            break
        low = new
    comp = np.array([got[i]["component_id"] for i in range(len(v))])
    assert (comp >= low).all() and (comp == low).mean() > 0.9
    assert all(got[i]["kept"] == (got[i]["component_id"] == i) for i in got)
    assert all((got[i]["n_links"], got[i]["component_id"]) == (0, i) for i, _ in bad)


def test_pipeline_on_small_data(spark, tmp_path, rows):
    import corpus_pipeline

    rng = np.random.default_rng(12)
    base = [f"v{rng.integers(3000)}" for _ in range(300)]
    near = base.copy()
    near[10] = "changed"
    more = [(5000, " ".join(base), "en", "s0"), (5001, " ".join(near), "en", "s1"), (5002, " ".join(base), "en", "s2")]
    docs(spark, [r for r in rows if r[0] is not None] + more).write.parquet(f"{tmp_path}/documents.parquet")
    stages = corpus_pipeline.STAGES
    start = spark.read.parquet(f"{tmp_path}/documents.parquet")
    told = stages[0][1](spark, start, "")
    ids = lambda frame: {r["doc_id"] for r in frame.select("doc_id").collect()}
    assert told.columns == start.columns and {5000, 5001, 5002} <= ids(told)
    exact_left = stages[1][1](spark, told, "")
    texts = lambda frame: {r["text"] or "" for r in frame.select("text").collect()}
    assert exact_left.count() == len(texts(told)) and texts(exact_left) == texts(told) and {5001, 5002} <= ids(exact_left)
    left = stages[2][1](spark, exact_left, "")
    assert left.columns == start.columns and ids(left) & {5000, 5001, 5002} == {5001} and ids(left) <= ids(exact_left)
    mixed = stages[3][1](spark, left, "")
    assert mixed.columns == start.columns and mixed.count() and ids(mixed) <= ids(left)
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    kept = {r["doc_id"] for r in out}
    assert kept == ids(mixed)
    assert len(kept & {5000, 5001, 5002}) <= 1 and not kept & {3000, 3001, 3002}
    assert len(kept & set(range(2000, 2009))) <= 1 and len(corpus_pipeline.STAGES) == 5


def test_near_stage_links_by_shingles(spark):
    """The pipeline's near-copy stage drops what a link of similarity 0.8 or more reaches, and nothing else; a band of pairs on both sides of it."""
    import corpus_pipeline

    rng, texts = np.random.default_rng(21), []
    for edits in (1, 3, 5, 7, 8, 9, 10, 12, 15):
        for _ in range(12):
            base = [f"v{rng.integers(50_000)}" for _ in range(400)]
            copy = base.copy()
            for i in np.linspace(6, 393, edits).astype(int):
                copy[i] = "changed"
            texts += [" ".join(base), " ".join(copy).upper()]
    crowd = [f"u{rng.integers(50_000)}" for _ in range(300)]  # a large group, and a text just below 0.8 to all of it
    texts += [" ".join(w if i != 7 * k % 290 + 5 else f"x{k}" for i, w in enumerate(crowd)) for k in range(40)]
    texts += [" ".join(w if i % 40 else "y" for i, w in enumerate(crowd))]
    table = docs(spark, [(i, t, "en", "s") for i, t in enumerate(texts)] + [(None, texts[0], "en", "s"), (900, None, "en", "s"), (901, " ", "en", "s")])
    got = {r["doc_id"] for r in corpus_pipeline._near(spark, table, "").collect()}
    split = [t.lower().split() for t in texts]
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in split]
    low = list(range(len(sets)))
    near = [(i, j) for i in range(len(sets)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    assert 60 < len(near)
    for _ in range(50):
        for i, j in near:
            low[i] = low[j] = min(low[i], low[j])
    assert got == {i for i, x in enumerate(low) if i == x} | {None, 900}


def test_sketches_of_whole_sets_tell_pairs_apart():
    """Pairs of the least similarity pass, those well below it don't, with sets sketched whole, in part and on two sides of a level."""
    rng = np.random.default_rng(4)

    def pair(m, n, similarity):
        inter = int(round((m + n) * similarity / (1 + similarity)))
        h = rng.integers(0, 2**64, m + n - inter, dtype=np.uint64)
        return simhash.set_sketch(h[:m], 0.8), simhash.set_sketch(h[m - inter :], 0.8)

    for m, n in ((3, 3), (60, 60), (400, 400), (400, 490), (1900, 2200), (30_000, 35_000)):
        for similarity, low, high in ((0.81, 0.98, 1), (0.6, 0, 0.6 if m < 10 else 0.1), (0.72, 0, 1 if m < 100 else 0.05)):
            x, y = (simhash.stacked(z) for z in zip(*(pair(m, n, similarity) for _ in range(100)), strict=True))
            assert low <= simhash.may_reach(x, y, 0.8).mean() <= high, (m, n, similarity)
    x, y = (simhash.stacked(z) for z in zip(*(pair(400, 600, 0.65) for _ in range(5)), strict=True))
    assert not simhash.may_reach(x, y, 0.8).any()  # sizes alone rule them out
    nothing = simhash.stacked([simhash.set_sketch(np.zeros(0, np.uint64), 0.8)])
    assert simhash.may_reach(nothing, nothing, 0.8).all()


def test_family_below_the_threshold_gives_few_pairs(spark, monkeypatch):
    """Copies of one text, each with its own edits: nearly all pairs lie below 0.8, and few of them are written."""
    rng, n = np.random.default_rng(5), 160
    base = [f"b{rng.integers(50_000)}" for _ in range(400)]
    texts = []
    for k in range(n):
        copy = base.copy()
        for i in rng.choice(400, 7, replace=False):
            copy[i] = f"e{k}x{i}"
        texts.append(" ".join(copy))
    written, keep = {}, simhash.materialize

    def counted(df, label, *rest):
        out = keep(df, label, *rest)
        written[label] = written.get(label, 0) + out.count()
        return out

    monkeypatch.setattr(simhash, "materialize", counted)
    got = {r["doc_id"] for r in simhash.drop_near_copies(docs(spark, [(i, t, "en", "s") for i, t in enumerate(texts)])).collect()}
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, texts)]
    links = [(i, j) for i in range(n) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    low = list(range(n))
    for _ in range(n):
        for i, j in links:
            low[i] = low[j] = min(low[i], low[j])
    assert got == {i for i, x in enumerate(low) if i == x}
    assert written["rest-pairs"] + written["more-pairs"] <= n


def test_warc_null_and_large_ids(spark):
    big, html = 2**60 + 1, "<p>" + "x" * 200
    rows = [(big, "u", html), (big + 2, "u", html), (None, "u", html), (None, None, "short"), (None, "v", "y" * 300), (7, "u", "short")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    index = warc.write_archives(pages)
    assert sorted(r["page_id"] or 0 for r in index.collect()) == [0, 0, 0, 7, big, big + 2]
    got = [(r["page_id"], r["record_type"], r["refers_to"], None if r["payload"] is None else bytes(r["payload"]).decode(), r["valid"]) for r in warc.read_records(index).collect()]
    want = [(i, "response", None, h, True) for i, _, h in rows if i != big + 2] + [(big + 2, "revisit", big, None, True)]
    assert sorted(got, key=repr) == sorted(want, key=repr)


IDS = [None, -1, 0, 2**53 + 1, 2**60 + 1, 2**60 + 1, 2**63 - 1]


@pytest.mark.parametrize(
    "operator",
    [
        lambda d: mix.mix_sizes(d),
        lambda d: tokens.count_tokens(d, tokenizer_path("byte_bpe_50k.json")),
        lambda d: substring.remove_repeats(d),
        lambda d: simhash.simhash_groups(d),
        lambda d: exact.exact_groups(d),
        lambda d: langid.predict_languages(d),
        lambda d: packing.pack_documents(d, tokenizer_path("word_bpe_49k.json")),
        lambda d: simhash.drop_near_copies(d),
        lambda d: mix.mix_documents(d, weights=(1,)),
    ],
)
def test_ids_stay_exact(spark, operator):
    """Ids come back as they are: null, negative, above 2**53 and repeated, all in one batch."""
    rng = np.random.default_rng(2)
    table = docs(spark, [(i, rng_text(rng, 40, 5000), "en", "s") for i in IDS]).coalesce(1)
    key = lambda i: (i is not None, i or 0)
    assert sorted((r["doc_id"] for r in operator(table).select("doc_id").collect()), key=key) == sorted(IDS, key=key)


def test_matrix_ids_stay_exact(spark):
    table = docs(spark, [(i, "some words", "en", "s") for i in IDS]).coalesce(1)
    got = [i for r in tokenbin.packed_matrices(table, tokenizer_path("word_bpe_49k.json")).collect() for i in r["doc_ids"]]
    key = lambda i: (i is not None, i or 0)
    assert sorted(got, key=key) == sorted(IDS, key=key)


def test_matrix_shares_of_equal_rows(spark):
    """Thousands of equal rows are dealt over all shares alike."""
    table = spark.range(0, 9000, 1, 4).select(F.lit(7).cast("long").alias("doc_id"), F.lit("equal words in all rows").alias("text"))
    index = tokenbin.write_matrices(table, tokenizer_path("word_bpe_49k.json"), capacity=16, share=1200)
    sizes = [r["n"] for r in index.groupBy("file").agg(F.sum(F.size("doc_ids")).alias("n")).collect()]
    assert sum(sizes) == 9000 and len(sizes) >= 150 and max(sizes) < 3 * 9000 / len(sizes)


def test_matrix_files_are_plain_rows(spark, tmp_path):
    """Files hold the rows and nothing else; a row whose bytes have changed is not valid."""
    path = tokenizer_path("word_bpe_49k.json")
    index = tokenbin.write_matrices(docs(spark, [(i, f"word {i}", "en", "s") for i in range(50)]), path, str(tmp_path / "m"), capacity=16)
    rows = index.orderBy("file", "row").collect()
    files = {r["file"] for r in rows}
    assert sum((tmp_path / "m" / f.rpartition("/")[2]).stat().st_size for f in files) == 2 * 16 * len(rows)
    first = tmp_path / "m" / rows[0]["file"].rpartition("/")[2]
    first.write_bytes(b"\xff" + first.read_bytes()[1:])
    assert [(r["file"], r["row"]) for r in tokenbin.read_matrices(index, 16).where("not valid").collect()] == [(rows[0]["file"], 0)]


def test_embeddings_recall_over_many_lists(spark, monkeypatch):
    """Dozens of lists, pairs just over the threshold, a cluster larger than a list, and two lengths of vectors."""
    monkeypatch.setattr(pq, "LIST", 60)
    rng, dim = np.random.default_rng(31), 24
    base = rng.normal(size=(900, dim))
    base /= np.linalg.norm(base, axis=1, keepdims=True)

    def beside(v, cosine):
        w = rng.normal(size=v.shape)
        w -= (w @ v) * v
        return cosine * v + np.sqrt(1 - cosine**2) * w / np.linalg.norm(w)

    vectors = [*base, *[beside(v, c) for v, c in zip(base[:600], np.linspace(0.951, 0.97, 600), strict=True)]]
    vectors += [beside(base[0], 0.99) for _ in range(200)]
    other = rng.normal(size=(30, 7))
    vectors += [*other, *(other * 3 + 1e-3)]
    got = {r["vec_id"]: r for r in pq.embedding_groups(spark.createDataFrame(list(enumerate(v.tolist() for v in vectors)), "vec_id long, embedding array<double>")).collect()}
    found = true = 0
    for part in ([i for i, v in enumerate(vectors) if len(v) == n] for n in (dim, 7)):
        x = np.array([vectors[i] for i in part])
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        links = (x @ x.T >= 0.95).sum(1) - 1
        own = np.array([got[i]["n_links"] for i in part])
        assert (own <= links).all()
        if len(x) < 100:
            assert (own == links).all()
        found, true = found + own.sum(), true + links.sum()
    assert true > 20_000 and found >= 0.95 * true
    pairs = [got[i]["component_id"] == got[900 + i]["component_id"] for i in range(600)]
    assert np.mean(pairs) >= 0.95


def test_language_stage_without_labels_keeps_texts(spark):
    import corpus_pipeline

    table = docs(spark, [(i, t, None, "s") for i, t in enumerate(["some text", "1 2 3", None, "", "\u65e5\u672c"])])
    assert sorted(r["doc_id"] for r in corpus_pipeline._language(spark, table, "").collect()) == [0, 4]


def test_exact_stage_takes_null_and_empty_as_one(spark):
    table = docs(spark, [(1, "", "en", "s"), (1, None, "en", "s"), (2, "x", "en", "s"), (2, "x", "en", "s")])
    assert sorted(r["doc_id"] for r in exact.drop_exact_copies(table).collect()) == [1, 2]
