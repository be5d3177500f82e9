"""MinHash grouping, the conversation trie and ranked search against brute
force and SQL, and over odd rows."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tests.conftest import SF_SMALL
from tests.llm.test_operators import LONG, ODD, PLAIN, COLUMNS, slow_groups
from tidemark.llm import lexical_search, prefix_trie, superminhash
from tidemark.llm.catalog import QUERIES
from tidemark.llm.common import table

TRIE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def nulls_first(row):
    return tuple((x is not None, x) for x in row)


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=nulls_first)


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, COLUMNS).selectExpr(
        "*", "1 AS set_id", "2 AS root", "3 AS text_key", "4 AS label", "5 AS key", "6 AS item", "7 AS score", "8 AS n", "9 AS kept")


# ------------------------------------------------------------ op11

def bag(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    return frozenset(zip(words, words[1:])) if len(words) > 1 else frozenset(map(tuple, [words] if words else []))


def slow_components(docs):
    """doc_id -> (set size, component) by comparing all pairs that share a shingle."""
    bags = {d: bag(t) for d, t in docs}
    having = defaultdict(list)
    for d in sorted(bags):
        for x in bags[d]:
            having[x].append(d)
    shared = Counter((a, b) for ds in having.values() for i, a in enumerate(ds) for b in ds[i + 1:])
    linked = {p for p, n in shared.items() if 100 * n >= 80 * (len(bags[p[0]]) + len(bags[p[1]]) - n)}
    groups = slow_groups(sorted(bags), lambda a, b: (min(a, b), max(a, b)) in linked)
    return {d: (len(bags[d]), groups[d]) for d in bags}


def edited(text, rng, n):
    words = text.split()
    for i in rng.choice(len(words), n, replace=False):
        words[i] = f"new{rng.integers(1 << 40)}"
    return " ".join(words)


@pytest.fixture(scope="module")
def copies(spark):
    """A large group of edited copies, most of them similar to their original alone, and chains."""
    rng = np.random.default_rng(5)
    base = [" ".join(f"w{rng.integers(3000)}" for _ in range(200)) for _ in range(4)]
    texts = [edited(base[0], rng, int(rng.integers(6, 14))) for _ in range(120)] + base + [base[1]] * 30
    chain = base[2]
    for _ in range(12):
        chain = edited(chain, rng, 9)
        texts.append(chain)
    texts += [" ".join(f"x{rng.integers(9000)}" for _ in range(60)) for _ in range(100)] + ["one", "ONE", "", None, "a b", "A\tb"]
    docs = list(enumerate(rng.permutation(np.array(texts, object)).tolist()))
    return docs, spark.createDataFrame(docs, "doc_id long, text string").repartition(5)


@pytest.mark.parametrize("block,dense", [(1500, 4096), (25, 4096), (25, 20)])
def test_near_duplicates_against_all_pairs(spark, copies, monkeypatch, block, dense):
    """Also where a group is cut into blocks, and where a bucket is too large to be compared."""
    monkeypatch.setattr(superminhash, "BLOCK_SETS", block)
    monkeypatch.setattr(superminhash, "DENSE", dense)
    docs, df = copies
    got = superminhash.near_duplicates(spark, df).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == slow_components(docs)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_duplicates_of_the_given_documents(spark):
    docs = table(spark, SF_SMALL, "documents")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in QUERIES["op11_superminhash"](spark, SF_SMALL).collect()}
    assert got == slow_components([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])


def slow_superminhash(hashes, slots):
    """One shingle after the other, each through all its ranks."""
    mask, golden = (1 << 64) - 1, 0x9E3779B97F4A7C15

    def mix(x):
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & mask
        x = (x ^ x >> 27) * 0x94D049BB133111EB & mask
        return x ^ x >> 31

    out = [mask] * slots
    for h in hashes:
        perm = list(range(slots))
        for j in range(slots):
            x = mix(h + (j + 1) * golden & mask)
            k = j + ((x & 0xFFFFFFFF) * (slots - j) >> 32)
            perm[j], perm[k] = perm[k], perm[j]
            out[perm[j]] = min(out[perm[j]], j << 32 | x >> 32)
    return out


def test_signatures(monkeypatch):
    """Early stopping and common ranks change no signature; estimates are close."""
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64)) for n in (1, 2, 9, 60, 400)]
    want = [slow_superminhash(s.tolist(), 160) for s in sets]
    assert superminhash.signatures(sets).tolist() == want
    monkeypatch.setattr(superminhash, "ELEMENTS", 7)
    assert superminhash.signatures(sets).tolist() == want
    errors = []
    for _ in range(300):
        both, a, b = (rng.integers(0, 1 << 63, n, dtype=np.uint64) for n in (80, 10, 10))
        x, y = superminhash.signatures([np.concatenate([both, a]), np.concatenate([both, b])])
        errors.append((x == y).mean() - 0.8)
    assert abs(np.mean(errors)) < 0.01
    assert np.std(errors) < math.sqrt(0.8 * 0.2 / 160)  # what independent hashes would give


def test_near_duplicates_odd_rows(spark, odd):
    got = superminhash.near_duplicates(spark, odd).collect()
    assert len(got) == len(ODD)
    at = defaultdict(list)
    for r in got:
        at[r.doc_id].append(r)
    assert {r.component_id for r in at[4] + at[5]} == {4} and len(at[4]) == 2 and all(r.kept for r in at[4])
    assert {r.component_id for r in at[6] + at[7]} == {6} and [r.kept for r in at[7]] == [False]
    assert [(r.n_shingles, r.component_id, r.kept) for d in (1, 2, 3) for r in at[d]] == [(0, 1, True), (0, 2, True), (0, 3, True)]
    assert {(r.component_id, r.kept) for r in at[None]} == {(None, True)}
    assert {r.component_id for d in (10, 11) for r in at[d]} == {10}  # the sets of "a a a" and "A a A"
    assert superminhash.near_duplicates(spark, odd.limit(0)).count() == 0


# ------------------------------------------------------------ op12

def slow_trie(turns):
    own = defaultdict(list)
    for c, t, role, text in turns:
        if c is not None:
            own[c].append((t is not None, t or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    whole = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        whole[c] = own.get(c - c % 100, [])[:h] + own[c][h:]
    members, kids = defaultdict(list), defaultdict(list)
    for c in sorted(whole):
        for d in range(len(whole[c]) + 1):
            members[tuple(whole[c][:d])].append(c)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    leaves, saved, out = {}, {}, []
    for p in sorted(members, key=len, reverse=True):
        m = members[p]
        leaves[p] = sum(leaves[q] for q in kids[p]) if kids[p] else 1
        saved[p] = sum(saved[q] for q in kids[p]) + ((len(m) - 1) * len(p[-1][1]) if p else 0)
        ends = ",".join(str(c) for c in m if len(whole[c]) == len(p))
        out.append((m[0], len(p), members[p[:-1]][0] if p else None, len(m), len(kids[p]), leaves[p], saved[p],
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=nulls_first)


def odd_turns():
    """Shared beginnings, a conversation repeated often, one very long, groups without their first, ties, nulls."""
    rng = np.random.default_rng(3)
    turns = [(c, t, ["user", "assistant"][t % 2], f"w{rng.integers(3)}") for c in range(100, 420, 3) for t in range(int(rng.integers(1, 8)))]
    turns += [(c, t, "user", "same") for c in range(0, 60) for t in range(3)]
    turns += [(500, t, "user", f"t{t}") for t in range(300)] + [(501, t, "user", f"t{t}") for t in range(250)]
    turns += [(600, None, "user", "first"), (600, 0, None, None), (600, 0, "user", "tie"), (600, 0, "user", "tie"), (600, 1, "x", "")]
    return turns + [(None, 0, "user", "nobody"), (701, 0, "user", "short"), (702, 0, "user", LONG)]


@pytest.mark.parametrize("limit,room,span", [(100_000, 50_000, 4096), (60, 8, 16), (1, 2, 3)])
def test_trie_against_brute_force(spark, monkeypatch, limit, room, span):
    """In one shard, and in many with queues that spill and conversations added up in spans."""
    monkeypatch.setattr(prefix_trie, "QUEUE", room)
    monkeypatch.setattr(prefix_trie, "SPAN", span)
    turns = odd_turns()
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").selectExpr(
        "*", "1 AS depth", "2 AS key", "3 AS shard", "4 AS size", "5 AS part").repartition(7)
    assert rows(prefix_trie.trie(spark, df, limit), *TRIE) == slow_trie(turns)


def test_conversations_over_several_ranges(spark, monkeypatch):
    turns = odd_turns()
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        numbered = prefix_trie._numbered(spark, df)
        long = sorted(r.i for r in numbered.where("conv_id = 500").collect())
        assert long == list(range(300))
        assert spark.read.parquet(*{f.rsplit("/", 1)[0] for f in numbered.inputFiles()}).count() == len(turns) - 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_trie_of_nothing(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    got = prefix_trie.trie(spark, none)
    assert got.columns == TRIE and got.count() == 0


def test_messages_come_in_order(tmp_path):
    rng = np.random.default_rng(2)
    queue, want = prefix_trie.Messages(f"{tmp_path}/queue", 5), Counter()
    for _ in range(200):
        depth, key = int(rng.integers(4)), f"{rng.integers(6)}"
        queue.push(depth, key, 2, 3)
        want[depth, key] += 1
    for depth, key in sorted(want, key=lambda x: (-x[0], x[1])):
        assert queue.take(depth, key) == (want[depth, key], 2 * want[depth, key], 3 * want[depth, key])
    assert len(queue.spilled) > 1
    queue.close()
    assert not list((tmp_path / "queue").iterdir())


# ------------------------------------------------------------ op13

def slow_search(docs, items, top):
    term = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    find = lambda t: term.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    words = [(d, Counter(find(t))) for d, t in docs]
    n_docs = sum(1 for _, c in words if c)
    n_terms = sum(sum(c.values()) for _, c in words)
    df = Counter(t for _, c in words for t in c)
    out = []
    for item, text in sorted(set(items), key=repr):
        scored = []
        for d, c in words:
            m = 100 - 25 + 25 * sum(c.values()) * n_docs // max(1, n_terms)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 12 * m))
                        for t in find(text) if c[t])
            if score > 0:
                scored.append((-score, d is None, d or 0))
        out += [(item, i + 1, None if none else d, -s) for i, (s, none, d) in enumerate(sorted(scored)[:top])]
    return sorted(out, key=nulls_first)


@pytest.mark.parametrize("postings,intervals", [(400_000, 256), (200, 2)])
def test_search_against_brute_force(spark, monkeypatch, postings, intervals):
    """Also with small blocks and few intervals at a time; many documents tie."""
    monkeypatch.setattr(lexical_search, "POSTINGS", postings)
    monkeypatch.setattr(lexical_search, "INTERVALS", intervals)
    rng = np.random.default_rng(7)
    docs = [(int(d), " ".join(f"t{int(x)}" for x in rng.zipf(1.4, int(rng.integers(0, 40))) % 60)) for d in rng.permutation(700)]
    docs += [(1000 + i, "tie Tie-TIE common") for i in range(60)] + [(None, "tie tie tie common"), (2000, None), (2001, "Ä ö_é t1")]
    items = [(i, " ".join(f"t{int(x)}" for x in rng.integers(0, 70, 12))) for i in range(25)]
    items += [(90, "tie"), (91, "common tie tie nowhere"), (92, None), (93, "nowhere"), (94, ""), (90, "tie"), (90, "t1"), (None, "Ä é")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(6)
    found = lexical_search.search(spark, df, spark.createDataFrame(items, "item_id long, text string"), 7)
    assert rows(found, "item_id", "rank", "doc_id", "score") == slow_search(docs, items, 7)


def test_search_in_chunks(spark, monkeypatch):
    whole = rows(QUERIES["op13_lexical_search"](spark, SF_SMALL), "item_id", "rank", "doc_id", "score")
    monkeypatch.setattr(lexical_search, "CHUNK_ITEMS", 15)
    assert rows(QUERIES["op13_lexical_search"](spark, SF_SMALL), "item_id", "rank", "doc_id", "score") == whole


def test_search_odd_rows(spark, odd):
    items = [(1, PLAIN), (2, "zero x"), (3, "word7 of9 tail"), (4, "一")]
    benchmark = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS doc_id", "2 AS rank", "3 AS chunk")
    want = slow_search([(d, t) for d, t, *_ in ODD], items, 20)
    assert rows(lexical_search.search(spark, odd, benchmark), "item_id", "rank", "doc_id", "score") == want
    assert lexical_search.search(spark, odd.limit(0), benchmark).count() == 0
    assert lexical_search.search(spark, odd, benchmark.limit(0)).count() == 0
