"""The ten operators against brute-force versions, round trips and SQL, and
over tables of odd rows: nulls, empty and long texts, ties, repeated rows,
no rows, extra columns with clashing names."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import public_tokenizers
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.conftest import SF_MID, SF_SMALL
from tests.oracle_harness import compare, duck_connect
from tidemark.llm import (components, decontaminate, html_text, kneser_ney, line_dedup, packing, quality_rules, simhash,
                          token_files, tokens, url_rules, warc)
from tidemark.llm.catalog import QUERIES, SQL
from tidemark.llm.common import new_dir, table

SF_LABELS = "/root/testdata/sf0.1"  # enough labelled rows of each kind
LONG = " ".join(f"word{i % 911} of{i % 97}" for i in range(15_000))
PLAIN = "the quick brown fox jumps over the lazy dog while seven other animals look on and say nothing at all " * 3
ODD = [
    (1, None, "en", "a"), (2, "", "en", "a"), (None, "null id text", None, None), (None, None, None, None),
    (3, " \n\t ", "de", None), (4, PLAIN, "en", "a"), (4, PLAIN, "en", "a"), (5, PLAIN, "fr", "b"),
    (6, LONG, "en", "b"), (7, LONG + " tail", "en", "b"), (8, "Ünïcode  two   spaces\r\n\u00a0nbsp \u3000 <|endoftext|> x", "xx", "a"),
    (9, "one", "en", "a"), (10, "A a A", "en", "a"), (11, "a A a", "en", "a"), (12, "\x00zero \x00", "en", "a"),
]
COLUMNS = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="module")
def odd(spark):
    """Rows of ODD with columns whose names the operators use themselves."""
    df = spark.createDataFrame(ODD, COLUMNS)
    return df.selectExpr("*", "1 AS fp", "2 AS root", "3 AS text_key", "4 AS raw", "5 AS _text", "6 AS trusted", "7 AS kept",
                         "8 AS _bad_id", "9 AS host", "10 AS n_dropped", "11L AS n_chars", "12 AS page_id2")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(4, 1, 0), (4, 1, 0), (6, 1, 0), (7, 1, 1), (9, 0, 0), (None, 1, 0), (10, None, None)],
                                 "doc_id long, quality int, toxic int")


def rows(df):
    return [tuple(r) for r in df.collect()]


def sample(spark, n=400):
    """Whole rows of the smallest documents table."""
    return table(spark, SF_SMALL, "documents").limit(n)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, name):
    r = compare(spark, duck_connect(SF_MID), name, QUERIES[name], SQL[name], SF_MID)
    assert r.get("ok"), r


# --- 1 -----------------------------------------------------------------

def slow_fingerprint(text, size=4):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    parts = [" ".join(words[i:i + size]) for i in range(len(words) - size + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_groups(nodes, linked):
    """node -> smallest node reachable."""
    root = {x: x for x in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    nodes = sorted(nodes)
    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if linked(a, b):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {x: find(x) for x in nodes}


def test_simhash_against_all_pairs(spark):
    docs = sample(spark)
    texts = dict(rows(docs.select("doc_id", "text")))
    prints = {d: slow_fingerprint(t) for d, t in texts.items()}
    expected = slow_groups(list(texts), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 4)
    got = {r.doc_id: (r.fp % 2**64, r.component_id) for r in simhash.near_duplicates(spark, docs).collect()}
    assert got == {d: (prints[d], expected[d]) for d in texts}


def test_dense_buckets_lose_no_link(spark):
    rng = np.random.default_rng(7)
    base = rng.integers(0, 2**63, 6, dtype=np.uint64)
    flips = [sum(1 << int(b) for b in rng.choice(64, int(rng.integers(0, 5)), replace=False)) for _ in range(600)]
    fps = sorted({int(base[i % 6]) ^ f for i, f in enumerate(flips)})
    signed = [x - 2**64 if x >= 2**63 else x for x in fps]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    expected = slow_groups(signed, lambda a, b: ((a ^ b) % 2**64).bit_count() <= 4)
    for block in (4096, 16):  # 16: hot buckets are cut into pairs of blocks
        found = simhash.links(spark, df, 4, block)
        assert all(((a ^ b) % 2**64).bit_count() <= 4 for a, b in rows(found))
        roots = dict(rows(components.components(spark, found)))
        assert {x: roots.get(x, x) for x in signed} == expected


def test_segments_cover_the_distance():
    for distance in range(0, 12):
        segs = simhash.segments(distance)
        assert sum(w for _, w in segs) == 64 and 2 * len(segs) > distance >= 2 * (len(segs) - 1)


def test_simhash_odd_rows(spark, odd, none):
    got = simhash.near_duplicates(spark, odd).collect()
    assert len(got) == len(ODD)
    zero = [r for r in got if r.fp == 0]
    assert len(zero) == 4 and {r.component_id for r in zero} == {1}
    kept = simhash.keep_one(spark, odd)
    assert kept.columns == odd.columns
    expected = len({r.root for r in got})
    assert kept.count() == expected
    assert sum(r.doc_id == 4 for r in kept.collect()) == 1
    assert simhash.near_duplicates(spark, none).count() == 0 and simhash.keep_one(spark, none).count() == 0


def test_components_of_chains_and_loops(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, 100), (200, 201), (201, 200)]
    got = dict(rows(components.components(spark, spark.createDataFrame(links, "u long, v long"))))
    assert got == {i: 0 for i in range(61)} | {200: 200, 201: 200}


# --- 2 -----------------------------------------------------------------

def slow_features(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    inside = {i + d for i, w in enumerate(windows) if often[w] > 1 for d in range(3)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(inside)


def slow_ratio(all_texts, trusted, text):
    def bucket(four):
        return (int.from_bytes(four, "big") * 0x9E3779B97F4A7C15 % 2**64) >> (64 - quality_rules.BITS)

    def four(t):
        raw = t.encode()
        return [bucket(raw[i:i + 4]) for i in range(len(raw) - 3)]

    raw, target = Counter(), Counter()
    for t in all_texts:
        raw.update(four(t))
    for t in trusted:
        target.update(four(t))
    n, m = (sum(c.values()) + 0.5 * 2**quality_rules.BITS for c in (raw, target))
    grams = four(text)
    return sum(math.log((target[g] + 0.5) / m) - math.log((raw[g] + 0.5) / n) for g in grams) / len(grams) if grams else 0.0


def slow_cut(all_texts, trusted, prior):
    """The quantile of each trusted text's ratio without it among the trusted, drawn towards the prior."""
    passing = []
    for i, t in enumerate(trusted):
        n, *_, again = slow_features(t)
        if n >= 50 and 100 * again <= 50 * n:
            passing.append(round(1e4 * slow_ratio(all_texts, trusted[:i] + trusted[i + 1:], t)) / 1e4)
    m = len(passing)
    return max(prior, (m * np.quantile(passing, 0.01) + 30 * prior) / (m + 30)) if m else prior


@pytest.mark.parametrize("n,prior", [(60, -0.5), (200, -3.0)])
def test_quality_rules_against_brute_force(spark, n, prior):
    docs = sample(spark, n)
    texts = dict(rows(docs.select("doc_id", "text")))
    good = {d for d, q, t in rows(table(spark, SF_SMALL, "labels")) if q == 1 and t == 0}
    got = quality_rules.judge(spark, docs, table(spark, SF_SMALL, "labels"), prior).collect()
    assert len(got) == len(texts)
    for r in got:
        n, *rest = slow_features(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, *rest)
        assert r.base_failed == (n < 50 or 100 * rest[-1] > 50 * n)
    trusted = [texts[d] for d in texts if d in good]
    cut = slow_cut(texts.values(), trusted, prior)
    assert cut > prior or prior == -0.5
    for r in got:
        assert abs(r.log_ratio - cut) < 1e-4 or r.kept == (not r.base_failed and r.log_ratio >= cut)
    for r in got[:12]:
        expected = slow_ratio(texts.values(), [texts[d] for d in texts if d in good], texts[r.doc_id])
        assert r.log_ratio == pytest.approx(expected, abs=1e-4)


def test_quality_rules_keep_good_and_drop_junk(spark):
    got = {r.doc_id: r for r in quality_rules.judge(spark, table(spark, SF_MID, "documents"), table(spark, SF_MID, "labels")).collect()}
    by = defaultdict(list)
    for d, q, t in rows(table(spark, SF_MID, "labels")):
        if got[d].n_words >= 50 and t == 0:
            by[q].append(got[d].kept)
    assert np.mean(by[1]) > 0.99 and np.mean(by[0]) < 0.05


def test_quality_rules_drop_toxic_prose(spark):
    docs, labels = table(spark, SF_LABELS, "documents"), table(spark, SF_LABELS, "labels")
    got = quality_rules.judge(spark, docs, labels).where("not base_failed").join(labels, "doc_id")
    kept = {(r.quality, r.toxic): r.kept for r in got.groupBy("quality", "toxic").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()}
    assert kept[1, 0] > 0.99 and kept[1, 1] < 0.45 and kept[0, 0] < 0.01 and kept[0, 1] < 0.01


def test_repeated_words_of_huge_vocabularies(monkeypatch):
    words = [b"a", b"b", b"c", b"d", b"a", b"b", b"c", b"e"]
    assert quality_rules.repeated_words(words) == 6
    monkeypatch.setattr(quality_rules, "IDS", 2)
    assert quality_rules.repeated_words(words) == 6


def test_quality_rules_odd_rows(spark, odd, none, labels):
    got = quality_rules.judge(spark, odd, labels).collect()
    assert len(got) == len(ODD)
    for r in got:
        if r.doc_id in (1, 2, 3):
            assert r.base_failed and not r.kept and r.n_words == 0
    alone = quality_rules.judge(spark, odd, labels.limit(0)).collect()
    assert all(r.log_ratio is None and r.kept == (not r.base_failed) for r in alone)
    assert quality_rules.judge(spark, none, labels).count() == 0


# --- 3 -----------------------------------------------------------------

def slow_leaks(texts, items):
    found = set()
    for item, text in items:
        w = decontaminate.words_of(text or "")
        size = min(5, len(w))
        for doc, whole in texts:
            v = decontaminate.words_of(whole or "")
            span = min(len(w), len(v))
            if not w or span < size:
                continue
            bag = Counter(zip(*(w[i:] for i in range(size))))
            for s in range(len(v) - span + 1):
                here = Counter(zip(*(v[s + i:s + span] for i in range(size))))
                if sum((bag & here).values()) >= 0.8 * sum((bag | here).values()):
                    found.add((doc, item))
                    break
    return found


def test_decontamination_against_all_windows(spark):
    docs, items = sample(spark), table(spark, SF_SMALL, "benchmark")
    first = rows(items.select("item_id", "text"))
    words = first[0][1].split()
    made = [(10**6 + i, t) for i, t in enumerate([
        " ".join(words), " ".join(words[1:]), " ".join(["x"] * 40 + words + ["y"] * 40), " ".join(words[: len(words) // 2]),
        " ".join(words).upper(), ", ".join(words), " ".join(words[:3] + ["other"] + words[4:]), " ".join(words[:-1] + ["other"])])]
    both = docs.select("doc_id", "text").union(spark.createDataFrame(made, "doc_id long, text string"))
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(spark, both, items).collect()}
    assert got == slow_leaks(rows(both), first)
    assert {10**6 + i for i in (0, 2, 4, 5)} <= {d for d, _ in got}


def test_benchmark_in_chunks(spark, monkeypatch):
    docs, items = sample(spark), table(spark, SF_SMALL, "benchmark")
    whole = sorted(rows(decontaminate.leaks(spark, docs, items)))
    monkeypatch.setattr(decontaminate, "CHUNK_ITEMS", 7)
    assert sorted(rows(decontaminate.leaks(spark, docs, items))) == whole and whole


def test_decontamination_odd_rows(spark, odd, none):
    items = spark.createDataFrame([(1, PLAIN), (1, PLAIN), (2, None), (3, ""), (4, "null id text"), (None, "one"), (5, "...")],
                                  "item_id long, text string")
    got = [(r.doc_id, r.item_id) for r in decontaminate.leaks(spark, odd, items).collect()]
    assert sorted(got, key=repr) == sorted([(4, 1), (4, 1), (5, 1), (None, 4), (9, None)], key=repr)
    left = decontaminate.drop_leaks(spark, odd, items)
    assert left.columns == odd.columns and left.count() == len(ODD) - 5
    assert decontaminate.leaks(spark, none, items).count() == 0
    assert decontaminate.leaks(spark, odd, items.limit(0)).count() == 0


# --- 4 -----------------------------------------------------------------

def slow_kneser_ney(train, order):
    """p(bytes): probability of the last byte after the others."""
    counts = {order: Counter()}
    for raw in train:
        padded = b"\0" * (order - 1) + raw
        counts[order].update(padded[i:i + order] for i in range(len(raw)))
    for n in range(order - 1, 0, -1):
        counts[n] = Counter()
        for g, c in counts[n + 1].items():
            counts[n][g[1:]] += c if g[1:2] == b"\0" else 1
    models = {}
    for n, table_ in counts.items():
        k = Counter(table_.values())
        y = k[1] / (k[1] + 2 * k[2]) if k[1] else 0.75
        d = [i + 1 - (i + 2) * y * k[i + 2] / k[i + 1] if k[i + 1] else 0.75 for i in range(3)]
        d = [min(max(x, 0.05), i + 0.95) for i, x in enumerate(d)]
        total, freed = Counter(), Counter()
        for g, c in table_.items():
            total[g[:-1]] += c
            freed[g[:-1]] += d[min(c, 3) - 1]
        models[n] = d, total, freed

    def p(g):
        if not g:
            return 1 / 256
        d, total, freed = models[len(g)]
        below, c, h = p(g[1:]), counts[len(g)][g], g[:-1]
        if not total[h]:
            return below
        return ((c - d[min(c, 3) - 1] if c else 0) + freed[h] * below) / total[h]

    return p


@pytest.mark.parametrize("order", [3, 5])
def test_kneser_ney_against_brute_force(spark, order):
    docs = sample(spark, 60)
    got = kneser_ney.perplexities(spark, docs, table(spark, SF_SMALL, "labels"), order).collect()
    texts = dict(rows(docs.select("doc_id", "text")))
    assert len(got) == len(texts) and {r.role for r in got} >= {0, 1}
    p = slow_kneser_ney([texts[r.doc_id].encode() for r in got if r.role == 1], order)
    for r in got:
        raw = b"\0" * (order - 1) + texts[r.doc_id].encode()
        bits = [-math.log2(p(raw[i:i + order])) for i in range(len(raw) - order + 1)]
        assert r.bits == pytest.approx(sum(bits) / len(bits), abs=1e-5)


def test_probabilities_sum_to_one(spark):
    counts = Counter(int(g) for g in kneser_ney.grams(PLAIN.encode(), 3))
    seen = spark.createDataFrame([(g, c) for g, c in counts.items()], "gram long, cnt long")
    context = next(iter(counts)) >> 8
    wanted = spark.createDataFrame([(c << 8 | b,) for c in (context, 0x7A7A) for b in range(256)], "gram long")
    got = defaultdict(float)
    for g, p in rows(kneser_ney.probabilities(spark, seen, wanted, 3)):
        got[g >> 8] += p
    assert got == pytest.approx({context: 1.0, 0x7A7A: 1.0})


def test_classifier_on_labels(spark):
    got = {r.doc_id: r.kept for r in kneser_ney.classify(spark, table(spark, SF_MID, "documents"), table(spark, SF_MID, "labels")).collect()}
    by = defaultdict(list)
    for d, q, t in rows(table(spark, SF_MID, "labels")):
        if t == 0:
            by[q].append(got[d])
    assert len(got) == 1000 and np.mean(by[1]) > 0.97 and np.mean(by[0]) < 0.35


def test_classifier_drops_toxic_prose(spark):
    """Clean texts count only where the model was not trained on them."""
    labels = table(spark, SF_LABELS, "labels")
    scored = kneser_ney.classify(spark, table(spark, SF_LABELS, "documents"), labels).join(labels, "doc_id")
    held_out = F.pmod("text_key", F.lit(kneser_ney.HELD_OUT)) == 0
    got = scored.where(held_out | ~F.expr("quality = 1 and toxic = 0")).groupBy("quality", "toxic").agg(F.avg(F.col("kept").cast("int")).alias("kept"))
    kept = {(r.quality, r.toxic): r.kept for r in got.collect()}
    assert kept[1, 0] > 0.95 and kept[1, 1] < 0.5 and kept[0, 0] < 0.06 and kept[0, 1] < 0.06


def test_model_grows_with_its_text(spark):
    """Ten times the trusted text holds clearly more distinct n-grams."""
    sizes = []
    for sf in (SF_MID, SF_LABELS):
        good = table(spark, sf, "labels").where("quality = 1 and toxic = 0").select("doc_id")
        raws = [r.text.encode() for r in table(spark, sf, "documents").join(good, "doc_id", "left_semi").select("text").collect()]
        sizes.append(len(kneser_ney._distinct(raws, kneser_ney.ORDER)[0]))
    assert sizes[1] > 1.7 * sizes[0], sizes


def test_thresholds_against_brute_force(spark):
    """Languages with many, few and no held-out texts: a weighted mean of two quantiles."""
    docs, labels = table(spark, SF_MID, "documents"), table(spark, SF_MID, "labels")
    few = F.when(F.col("doc_id") % 29 == 0, "few").when(F.col("doc_id") % 31 == 0, F.lit(None)).otherwise(F.col("lang"))
    docs = docs.select("doc_id", "text", few.alias("lang"))
    scored = kneser_ney.perplexities(spark, docs, labels).toPandas()
    held = scored[(scored.role == 2) & scored.bits.notna()]
    names = scored.lang.where(scored.lang.notna(), None)

    def drawn(values, at):
        grid = (values * 1000).round() / 1000
        out = {}
        for lang in set(names):
            own = grid[held.lang.isna() if lang is None else held.lang == lang]
            out[lang] = (len(own) * (np.quantile(own, at) if len(own) else 0) + 20 * np.quantile(grid, at)) / (len(own) + 20)
        return out

    centre = drawn(held.bits, 0.5)
    score = (scored.bits * scored.n_bytes + 100 * names.map(centre)) / (scored.n_bytes + 100)
    cut = drawn(score[held.index], 0.97)
    assert min((held.lang == x).sum() for x in ("en", "few")) < 20 < (held.lang == "en").sum() or len(set(names)) > 4
    want = dict(zip(scored.doc_id, zip(score, names.map(cut))))
    for r in kneser_ney.classify(spark, docs, labels).collect():
        s, t = want[r.doc_id]
        assert r.threshold == pytest.approx(t, abs=3e-3)
        if s == s and abs(s - t) > 5e-3:
            assert r.kept == (s <= t) and r.score == pytest.approx(s, abs=3e-3)


def test_small_languages_have_a_threshold(spark):
    """Junk in a language without trusted texts is rejected."""
    docs = table(spark, SF_MID, "documents").select("doc_id", "text", "lang")
    junk = spark.createDataFrame([(-1, "zq#%x0 }{|qj~ " * 60, "xx"), (-2, PLAIN, "xx")], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in kneser_ney.classify(spark, docs.union(junk), table(spark, SF_MID, "labels")).collect()}
    assert not got[-1].kept and got[-1].threshold is not None and got[-1].threshold == got[-2].threshold


def test_classifier_odd_rows(spark, odd, none, labels):
    got = kneser_ney.classify(spark, odd, labels).collect()
    assert len(got) == len(ODD)
    assert all(not r.kept and r.bits is None for r in got if r.doc_id in (1, 2))
    kept = kneser_ney.keep_good(spark, odd, labels)
    assert kept.columns == odd.columns and 4 in {r.doc_id for r in kept.collect()}
    untrained = kneser_ney.classify(spark, odd, labels.limit(0)).collect()
    assert all(r.kept == (r.bits is not None) for r in untrained)
    assert kneser_ney.classify(spark, none, labels).count() == 0


# --- 5, 10 -------------------------------------------------------------

@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_encoder_matches_the_library(spark, library, monkeypatch):
    enc = tokens.Encoder(tokens.default_tokenizer())
    texts = [t or "" for _, t, *_ in ODD] + [r.text for r in sample(spark).collect()]
    texts += [" lead", "trail ", "a \nb", "a\n b", "a  b", "\t", " ", "  ", "it's we'll'", "x" * 300 + " y", "é\u0301 ß ﬁ 👩‍👩‍👧 ١٢٣ a\u2028b \x85 c \x1c d"]
    for cache in (300_000, 5):
        monkeypatch.setattr(tokens, "CACHE_WORDS", cache)
        assert [np.frombuffer(b, "<u4").tolist() for b in enc.encode(texts)] == [library(t) for t in texts]
    assert np.frombuffer(enc.encode(["a <|endoftext|> b"])[0], "<u4").tolist() == [64, 220, 50256, 275]


def check_packing(got, ids_of, capacity=1024):
    pieces, bins = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r.doc_id].append(r)
        bins[r.sequence_id].append(r)
    for doc, ids in ids_of.items():
        at = 0
        for r in sorted(pieces[doc], key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(ids)
            assert r.ids_crc32 == crc(ids[at:at + r.length])
            at += r.length
        assert at == len(ids)
    assert pieces.keys() == ids_of.keys()
    padding = 0
    for rs in bins.values():
        at = 0
        for r in sorted(rs, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
        padding += 0 if at & (at - 1) == 0 else capacity - at
    return padding / sum(map(len, ids_of.values()))


def test_packing_is_a_partition(spark, library):
    docs = sample(spark)
    ids = {d: library(t) + [0] for d, t in rows(docs.select("doc_id", "text"))}
    assert check_packing(packing.pack(spark, docs).collect(), ids) < 0.02


def test_cuts_waste_little():
    for n in range(1, 5000):
        out = packing.cuts(n)
        assert sum(out) == n and all(0 < x <= 1024 for x in out)
        assert all(1024 - (1024 // x) * x <= 16 for x in out)


def test_packing_odd_rows(spark, odd, none, library):
    unique = odd.where("doc_id <> 4")
    ids = {d: library(t) + [0] for d, t, *_ in ODD if d not in (4, None)}
    check_packing(packing.pack(spark, unique).collect(), ids)
    whole = packing.pack(spark, odd).collect()
    assert sum(r.length for r in whole) == sum(len(library(t)) + 1 for _, t, *_ in ODD)
    assert packing.pack(spark, none).count() == 0


def test_token_files_round_trip(spark, library):
    docs = table(spark, SF_SMALL, "documents")
    start = 0
    got = sorted(rows(token_files.read_shards(spark, token_files.write_shards(spark, docs, new_dir(spark, "t")))))
    for (d, text), r in zip(sorted(rows(docs.select("doc_id", "text"))), got, strict=True):
        ids = library(text) + [2]
        assert r == (d, start, len(ids), crc(ids))
        start += len(ids)


def test_token_file_format(spark, library):
    folder = new_dir(spark, "t")
    docs = spark.createDataFrame([(2, "b c"), (1, "a"), (3, None)], "doc_id long, text string").coalesce(1)
    manifest = token_files.write_shards(spark, docs, folder).orderBy("shard").collect()
    ids, docs_read = [], []
    for m in manifest:
        stem = token_files.file_system(m.path)[1]
        assert m.base_tokens == len(ids) and m.base_docs == len(docs_read)
        ids += np.memmap(f"{stem}.bin", "<u2", "r").tolist()
        docs_read += np.memmap(f"{stem}.doc", "<i8", "r").tolist()
        assert np.memmap(f"{stem}.off", "<u8", "r")[-1] == m.n_tokens
    assert docs_read == [1, 2, 3] and ids == library("a") + [2] + library("b c") + [2, 2]


def test_token_files_odd_rows(spark, odd, none, library):
    got = rows(token_files.read_shards(spark, token_files.write_shards(spark, odd, new_dir(spark, "t"))))
    assert sorted(x[2:] for x in got) == sorted((len(i), crc(i)) for i in (library(t) + [2] for _, t, *_ in ODD))
    got.sort(key=lambda x: x[1])
    assert [x[0] for x in got][:2] == [None, None] and [x[0] for x in got][2:] == sorted(d for d, *_ in ODD if d is not None)
    assert all(a[1] + a[2] == b[1] for a, b in zip(got, got[1:]))
    assert token_files.read_shards(spark, token_files.write_shards(spark, none, new_dir(spark, "t"))).count() == 0


# --- 6 -----------------------------------------------------------------

PARAGRAPH = "Long enough a paragraph to be taken for the text of an article, with more than sixty characters in it."
PAGES = [
    (f"<html><body><nav><a href=/>Home</a></nav><article><h1>T &amp; t</h1><p>One<br>two &lt;b&gt;</p><p>Ti.</p></article>"
     f"<footer>&copy; x</footer></body></html>", "T & t One two <b> Ti."),
    (f"<div class='cookie-notice'>We use cookies {PARAGRAPH}</div><ul><li><a>Home</a><li><a>News</a></ul><p>{PARAGRAPH}</p>"
     f"<aside>{PARAGRAPH}</aside><p>{PARAGRAPH} End.</p><div id=comments><p>{PARAGRAPH}</p></div>", f"{PARAGRAPH} {PARAGRAPH} End."),
    (f"<p>{PARAGRAPH}</p><script>var t='<p>no</p>';</script><style>p{{}}</style><!-- {PARAGRAPH} --><form>{PARAGRAPH}</form>", PARAGRAPH),
    (f"<article><p><b>Open {PARAGRAPH}<br><p>Next\n\t  line&nbsp;here", f"Open {PARAGRAPH} Next line here"),
    (f"<header>Site</header><article><header>Menu</header><p>A</p><div class=ad>Buy</div><p>B</p></article>", "A B"),
    (f"<nav><ul><li>x<article><p>{PARAGRAPH}</p></article>", PARAGRAPH),
    ("<p>Short.</p>", "Short."), ("plain text only", "plain text only"), ("", ""), ("<nav>only</nav>", ""),
    ("<div class='page has-sidebar sidebar'><p>All under one name.</p></div>", "All under one name."),
    ("<article><p>wo<b>r</b>d<i>s</i></p><p>a < b & c</p></article>", "words a < b & c"),
]


def test_main_text():
    for html, text in PAGES:
        assert html_text.main_text(html) == text, html


def test_articles_are_no_filter():
    other = PARAGRAPH.replace("Long", "Other")
    for html, text in [
        (f"<div><p>{PARAGRAPH}</p><p>{PARAGRAPH}</p></div><article><p>Teaser</p></article>", f"{PARAGRAPH} {PARAGRAPH}"),
        (f"<aside><article><p>{other}</p></article></aside><div><p>{PARAGRAPH}</p></div>", PARAGRAPH),
        (f"<ul class=comments><article>{other}</article></ul><p>{PARAGRAPH}</p>", PARAGRAPH),
        (f"<nav><ul><li>x<article><p>{PARAGRAPH}</p></article>", PARAGRAPH),
        (f"<div><nav><ul><li>x</div><p>{PARAGRAPH}</p>", PARAGRAPH),
        (f"<body><form><div><p>{PARAGRAPH}</p></div></form></body>", PARAGRAPH),
    ]:
        assert html_text.main_text(html) == text, html


def test_words_of_a_class_remove_no_article_text():
    for attribute in ("id='related-work'", "id='discussion'", "class='share-enabled has-comments'", "class='header-text'"):
        html = f"<article><p>{PARAGRAPH}</p><section {attribute}><h2>Part</h2><p>{PARAGRAPH}</p></section></article>"
        assert html_text.main_text(html) == f"{PARAGRAPH} Part {PARAGRAPH}", attribute
    post = "post type-post tag-news has-comments share-enabled"
    teaser = "<div class='related-posts'><p>Teaser of another article that is long enough to be a text of its own, by far.</p></div>"
    assert html_text.main_text(f"<div class='{post}'><p>{PARAGRAPH}</p></div>{teaser}") == PARAGRAPH
    for name in ("comments", "post-comments", "site-footer", "cookie-notice", "related", "ad-slot", "main-nav"):
        assert html_text.main_text(f"<div class='{post}'><p>{PARAGRAPH}</p></div><div class='{name}'><p>Other. {PARAGRAPH}</p></div>") == PARAGRAPH


@pytest.mark.parametrize("piece", ["<script", "<menu><article>", "<nav></x>", "<div></p></nav>", "<style>x", "<!--", "<a '", "&amp"])
def test_hostile_pages_take_linear_time(piece):
    import time
    for tail in ("", ">"):
        began = time.time()
        html_text.main_text(piece * (300_000 // len(piece)) + tail)
        assert time.time() - began < 10


def slow_texts(sizes, window, surge):
    """Texts of the line-block rule, from its definition: a maximal range of
    lines that no block of zero interrupts and one of ``surge`` confirms."""
    block = lambda i: sum(sizes[i:i + window])
    out, i = [], 0
    while i < len(sizes):
        if sizes[i]:
            z = i
            while z < len(sizes) and block(z):
                z += 1
            out.append((i, z))
            i = z
        i += 1
    return [(a, z) for a, z in out if max(map(block, range(a, z))) >= surge]


def test_line_blocks_against_brute_force():
    rng = np.random.default_rng(6)
    for _ in range(300):
        lines = [("x" * int(rng.choice([0, 0, 0, 5, 20, 40, 90])))[:int(rng.integers(0, 91))] for _ in range(int(rng.integers(1, 40)))]
        html = "".join(f"<p>{x}</p>" if x else "<aside></aside>" for x in lines)
        got_lines, sizes, _ = html_text.lines_of(html)
        want = slow_texts(sizes, html_text.WINDOW, html_text.SURGE)
        if want:
            assert html_text.main_text(html) == " ".join(x for a, z in want for x in got_lines[a:z] if x)


def test_extraction_of_the_given_pages(spark):
    got = html_text.extract(spark, table(spark, SF_SMALL, "pages")).collect()
    html = {r.page_id: r.html for r in table(spark, SF_SMALL, "pages").collect()}
    assert len(got) == len(html)
    for r in got:
        inner = re.search(r"(?s)<article>(.*?)</article>", html[r.page_id])[1]
        import html as std
        want = std.unescape(" ".join(re.sub(r"</?(?:p|h1|br)>", " ", re.sub(r"</?b>", "", inner)).split()))
        assert (r.text, r.n_chars) == (" ".join(want.split()), len(r.text))


def test_long_and_broken_markup():
    assert html_text.main_text("<a" * 50_000) is not None
    assert html_text.main_text("<p>" * 20_000 + PARAGRAPH) == PARAGRAPH
    assert html_text.main_text("<!-- open" + PARAGRAPH) == ""
    assert len(html_text.main_text("<article>" + f"<p>{PARAGRAPH}</p>" * 5_000 + "</article>")) == 5_000 * (len(PARAGRAPH) + 1) - 1


def test_extraction_odd_rows(spark):
    pages = spark.createDataFrame([(1, None, None), (None, "u", ""), (2, "v", "<p>x</p>"), (2, "v", "<p>x</p>")],
                                  "page_id long, url string, html string").selectExpr("*", "1 AS text", "2 AS n_chars")
    assert sorted(rows(html_text.extract(spark, pages)), key=repr) == sorted(
        [(1, None, "", 0), (None, "u", "", 0), (2, "v", "x", 1), (2, "v", "x", 1)], key=repr)
    assert html_text.extract(spark, pages.limit(0)).count() == 0


# --- 7 -----------------------------------------------------------------

def test_line_dedup_counts_distinct_pages(spark):
    docs = [(i, f"own line {i}\nshared footer\n\nown end {i}", "h") for i in range(20)]
    docs += [(100 + i, "copied page\nits second line", "h") for i in range(50)]
    docs += [(200 + i, f"shared footer\nonly {i}", "small") for i in range(3)]
    docs += [(300 + i, f"shared footer\nonly {i}", "two") for i in range(2)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    got = {r.doc_id: (r.text, r.n_dropped) for r in line_dedup.dedup_lines(spark, df).collect()}
    assert got[0] == ("own line 0\n\nown end 0", 1)
    assert got[100] == ("copied page\nits second line", 0)
    assert got[200] == ("only 0", 1)  # on all pages of a host of three
    assert got[300] == ("shared footer\nonly 0", 0)  # of two: too few to tell


def test_edited_copies_keep_their_lines(spark):
    """40 copies of a story, one line of each edited, among 200 other pages with a footer."""
    rng = np.random.default_rng(8)
    line = lambda: " ".join(f"w{rng.integers(5000)}" for _ in range(12))
    story = [line() for _ in range(20)]
    docs = []
    for i in range(40):
        mine = list(story)
        mine[i % 20] = line()
        docs.append((i, "\n".join([*mine, "read more on our site"]), "h"))
    docs += [(100 + i, "\n".join([*(line() for _ in range(6)), "read more on our site"]), "h") for i in range(200)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(4)
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(spark, df).collect()}
    assert got == {d: t.removesuffix("\nread more on our site") for d, t, _ in docs}


def test_line_dedup_counts_as_sql_over_given_pages(spark):
    docs = table(spark, SF_MID, "documents").select("doc_id", "source", "text")
    paged = line_dedup.with_page(spark, docs, "page").toPandas()
    con = duck_connect(SF_MID)
    con.register("paged", paged)
    con.execute("CREATE OR REPLACE TEMP VIEW documents AS SELECT * FROM paged")
    want = sorted(con.execute(line_dedup.SQL).fetchall(), key=repr)
    columns = ["doc_id", "source", "n_dropped", "text"]
    frame = spark.createDataFrame(list(paged.itertuples(index=False, name=None)), "doc_id long, source string, text string, page long")
    assert sorted(rows(line_dedup.dedup_lines(spark, frame, page="page").select(columns)), key=repr) == want
    assert sorted(rows(line_dedup.op7_line_dedup(spark, SF_MID).select(columns)), key=repr) == want
    assert sum(x[2] for x in want) > 100


def test_line_dedup_odd_rows(spark, odd, none):
    df = odd.drop("n_dropped")
    got = line_dedup.dedup_lines(spark, df, ratio=0.0, prior=0)
    assert got.columns == [*df.columns, "n_dropped"] and got.count() == len(ODD)
    for r in got.collect():
        if r.doc_id in (2, 3, 9):
            assert r.text == {2: "", 3: " ", 9: ""}[r.doc_id] or r.doc_id == 3
        if r.doc_id == 1:
            assert r.text is None and r.n_dropped == 0
        if r.doc_id == 9:
            assert r.n_chars == 0 and r.n_dropped == 1
    assert line_dedup.dedup_lines(spark, none).count() == 0


# --- 8 -----------------------------------------------------------------

URLS = [("http://A.Example.ORG/es/1?x#y", "example.org/es/", "block"), ("https://example.org/en/123", "example.org/en/1", "block"),
        ("x://org/", "org/", "allow"), ("x://notexample.org/es/", "org/", "allow"), ("x://b.com/de/", "com/de/", "block"),
        ("x://com/fr/", "com/fr/", "allow"), ("x://b.com/it/", None, "allow"), ("x://b.org", None, "allow"),
        ("x://b.org?/es/", None, "allow"), (None, None, "allow"), ("", None, "allow"), ("example.org/es/", None, "allow"),
        ("x://Ä.org/É://y", "org/", "allow"), ("x://.org/", "org/", "allow"), ("x://org./", None, "allow"), ("://org/", "org/", "allow")]


def test_url_rules(spark):
    pages = spark.createDataFrame([(i, u) for i, (u, *_) in enumerate(URLS)] + [(0, URLS[0][0])], "page_id long, url string")
    pages = pages.selectExpr("*", "1 AS host", "2 AS rule", "3 AS verdict")
    got = url_rules.judge_urls(pages, url_rules.rules_frame(spark)).collect()
    assert len(got) == len(URLS) + 1
    for r in got:
        assert (r.rule, r.verdict) == URLS[r.page_id][1:], r
    assert url_rules.judge_urls(pages.limit(0), url_rules.rules_frame(spark)).count() == 0
    bare = url_rules.judge_urls(pages, url_rules.rules_frame(spark).limit(0), default="block").collect()
    assert len(bare) == len(URLS) + 1 and all(r.rule is None and r.verdict == "block" for r in bare)


def test_long_hosts_and_prefixes_that_clash(spark):
    """20,000 labels; with one hex digit most rules share their prefix with others."""
    import time
    urls = [f"x://{'a.' * 20_000}example.org/es/", f"x://{'b.' * 20_000}com/de/x", "x://org", "x://b.net/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    rules = url_rules.rules_frame(spark, [*url_rules.RULES, *((f"h{i}.net", "/", "block") for i in range(200))])
    url_rules.judge_urls(pages.limit(0), rules).collect()
    began = time.time()
    got = {r.page_id: (r.rule, r.verdict) for r in url_rules.judge_urls(pages, rules, prefix_hex=1).collect()}
    assert got == {0: ("example.org/es/", "block"), 1: ("com/de/", "block"), 2: (None, "allow"), 3: (None, "allow")}
    assert time.time() - began < 20
    plan = url_rules.judge_urls(pages, rules)._jdf.queryExecution().toString()
    joins = [x for x in plan[plan.index("== Physical"):].splitlines() if "Join" in x and "rule_prefix" in x]
    assert joins and not any("digest" in x.split("Inner")[0] for x in joins)


def test_url_rules_use_no_python(spark):
    plan = url_rules.op8_url_rules(spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# --- 9 -----------------------------------------------------------------

def test_warc_odd_rows(spark):
    big = "é" * 600
    data = [(1, "u\r\nX: y", big), (5, "u", big), (3, None, big), (5, "w", big), (7, "u", "s"), (8, "u", "s"), (9, "u", None),
            (None, "u", big), (None, None, "q" * 2_000_000)]
    pages = spark.createDataFrame(data, "page_id long, url string, html string").selectExpr("*", "1 AS digest", "2 AS first")
    files = warc.archive(spark, pages)
    got = rows(warc.read_records(spark, files).drop("url"))
    expected = []
    for page, _, html in data:
        raw = (html or "").encode()
        refers = 5 if html == big and page != 5 else None
        expected.append((page, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if refers else "response", refers))
    assert sorted(got, key=repr) == sorted(expected, key=repr)
    assert warc.archive(spark, pages.limit(0)).count() == 0


def test_members_and_index(spark):
    files = warc.archive(spark, table(spark, SF_SMALL, "pages")).collect()
    total = 0
    for f in files:
        path = warc.file_system(f.path)[1]
        data, at = open(path, "rb").read(), 0
        for line in open(f"{path}.idx"):
            offset, size, kind, name = line.split()
            assert int(offset) == at
            gz = zlib.decompressobj(31)
            record = gz.decompress(data[at:at + int(size)])
            assert gz.eof and not gz.unused_data and record.startswith(b"WARC/1.1\r\n") and record.endswith(b"\r\n\r\n")
            assert name.encode() in record and f"WARC-Type: {kind}".encode() in record
            at, total = at + int(size), total + 1
        assert at == len(data)
    assert total == table(spark, SF_SMALL, "pages").count()


def test_streams_of_several_members():
    from io import BytesIO
    import gzip
    parts = [b"a" * 700_000, b"b", b"c" * 10]
    assert b"".join(warc._inflated(BytesIO(b"".join(map(gzip.compress, parts))))) == b"".join(parts)
