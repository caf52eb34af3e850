"""Operators 11 to 13 against plain Python."""

from __future__ import annotations

import collections
import hashlib
import math
import os
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from compare import connect, oracle_rows, rows_of
from tidepool.llm import importance_resampling as IR
from tidepool.llm import prefix_trie as PT
from tidepool.llm import queries as Q
from tidepool.llm import simhash_dedup as SD
from tidepool.llm.common import table

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


# -- 11 ----------------------------------------------------------------------------------------------------------------


def plain_trie(rows):
    turns = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            turns[conv].append(((turn is not None, turn or 0), hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest(), (role, text)))
    turns = {k: [x[2] for x in sorted(v)] for k, v in turns.items()}
    built = {}
    for conv, own in turns.items():
        h = zlib.crc32(str(conv).encode()) % 6
        built[conv] = tuple(turns.get(conv - conv % 100, [])[:h] + own[h:])
    members = collections.defaultdict(list)
    for conv, path in built.items():
        for d in range(len(path) + 1):
            members[path[:d]].append(conv)
    children = collections.Counter(n[:-1] for n in members if n)
    leaves, saved = collections.Counter(), collections.Counter()
    for node, who in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += not children[node]
            saved[node[:d]] += (len(who) - 1) * len(node[-1][1]) if node else 0
    return collections.Counter(
        (
            min(who), len(node), min(members[node[:-1]]) if node else None, len(who), children[node], leaves[node], saved[node],
            hashlib.sha256(",".join(map(str, sorted(c for c in who if len(built[c]) == len(node)))).encode()).hexdigest(),
        )
        for node, who in members.items()
    )


NODE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def got_trie(df):
    return collections.Counter(tuple(r[k] for k in NODE) for r in df.collect())


@pytest.mark.parametrize(("segment", "screened"), [(4096, 8), (3, 2), (2, 0)])
def test_trie_equals_plain(spark, monkeypatch, segment, screened):
    monkeypatch.setattr(PT, "SEGMENT", segment)
    rng = random.Random(segment)
    rows = []
    for conv in rng.sample(range(250), 90):
        for turn in range(rng.choice([1, 2, 3, 5, 9])):
            rows.append((conv, rng.choice([None, turn, turn]), rng.choice(["user", "assistant", None]), rng.choice([None, "", "hi", "hello é", "the same long answer"])))
    rows += [(207, t, "user", "hi") for t in range(40)] + [(208, t, "user", "hi") for t in range(40)]  # long and alike
    rows += [(None, 1, "user", "nobody's"), (5, 1, "user", "twice"), (5, 1, "user", "twice")]
    df = spark.createDataFrame([(*r, "x", 7) for r in rows], "conv_id long, turn long, role string, text string, at string, depth int")
    assert got_trie(PT.prefix_trie(df, screened=screened)) == plain_trie(rows)


def test_trie_of_hot_conversations_and_copies(spark):
    """One conversation holds a third of all turns, hundreds are copies, hundreds have no turns left."""
    rows = [(100, t, "user", f"turn {t % 7}") for t in range(250)]
    rows += [(c, t, "user", f"copy {t}") for c in range(1000, 1200) for t in range(8)]
    rows += [(c, 0, "user", f"short {c}") for c in range(3010, 3090)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert got_trie(PT.prefix_trie(df)) == plain_trie(rows)


def test_trie_of_nothing(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert PT.prefix_trie(empty).count() == 0
    one = spark.createDataFrame([(103, None, None, None)], "conv_id long, turn long, role string, text string")
    assert got_trie(PT.prefix_trie(one)) == plain_trie([(103, None, None, None)])


def test_sketch_proves_most_single_prefixes(spark):
    rows = [(c, t, "user", f"{c} says {t}") for c in range(2000) for t in range(6)]
    convs, paths = PT._paths(PT._turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))
    chains = PT._chains(paths)
    proven = {r["conv_id"]: r["alone"] for r in PT.Sketch(chains, 12_000, 8).proven(chains).collect()}
    heads = {c: zlib.crc32(str(c).encode()) % 6 for c in range(2000)}
    assert all(a is None or c % 100 == 0 or a > min(heads[c], 6) for c, a in proven.items())  # never a prefix that others have
    assert sum(a is not None for a in proven.values()) > 1900


# -- 12 ----------------------------------------------------------------------------------------------------------------


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain_buckets(text):
    w = plain_words(text)
    return collections.Counter(zlib.crc32(" ".join(w[i : i + n]).encode()) % 10_000 for n in (1, 2, 3) for i in range(len(w) - n + 1))


def plain_resampled(docs, target, percent=5):
    source = collections.Counter()
    goal = collections.Counter()
    found = [(d, plain_words(t), plain_buckets(t)) for d, t in docs]
    for _, _, b in found:
        source += b
    for t in target:
        goal += plain_buckets(t)
    s_all, t_all = sum(source.values()), sum(goal.values())
    gain = lambda b: math.floor(1000 * math.log((goal[b] + 1) * (s_all + 10_000) / ((source[b] + 1) * (t_all + 10_000))))
    out = []
    for d, w, b in found:
        weight = sum(n * gain(x) for x, n in b.items())
        h = int(hashlib.sha256(f"42:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append([d, sum(b.values()), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(w)])
    best = sorted((x for x in out if x[5] >= 20), key=lambda x: (-x[3], x[0] is not None, x[0] or 0, -x[2]))
    for place, x in enumerate(best[: percent * len(best) // 100], 1):
        x[4] = place
    return collections.Counter(tuple(x[:5]) for x in out)


def test_resampling_equals_plain(spark):
    rng = random.Random(2)
    words = ["Alpha", "beta", "gamma", "DELTA", "é", "Ünder", "x1", "--", "日本", "w" * 300]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 2, 3, 19, 20, 60, 400])))) for i in range(300)]
    docs += [(7, docs[7][1]), (7, "alpha beta " * 30), (None, "alpha " * 40), (900, None), (901, ""), (902, "beta\x00gamma\tdelta " * 9000)]
    target = ["alpha beta gamma", None, "x1 " * 50]
    df = spark.createDataFrame([(*d, "x", 3) for d in docs], "doc_id long, text string, bucket string, rank int")
    goal = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id int, text string")
    for percent in (5, 40):
        got = collections.Counter(tuple(r[k] for k in ("doc_id", "n_features", "weight", "score", "rank")) for r in IR.resampled(df, goal, percent).collect())
        assert got == plain_resampled(docs, target, percent)
    assert IR.resampled(df.limit(0), goal).count() == 0
    nothing = {(r["weight"] >= 0, r["n_features"]) for r in IR.resampled(df.where("doc_id = 900"), goal.limit(0)).collect()}
    assert nothing == {(True, 0)}


def test_resampling_reads_texts_of_any_length():
    split = IR.Splitter()
    for text in (" " * 2_000_000, "\n" * 2_000_000, "a" * 2_000_000, "ab " * 40_000, "É-" * 40_000):
        count, buckets = IR.features(text, split)
        assert count == len(plain_words(text)) and collections.Counter(buckets.tolist()) == plain_buckets(text)


# -- 13 ----------------------------------------------------------------------------------------------------------------


def plain_fingerprint(text):
    words = [w for w in re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())]
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 4]), 42) for i in range(max(len(words) - 3, 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, distance=4):
    values = np.array(sorted(set(prints)), dtype=np.uint64)
    root = list(range(len(values)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(values)):
        for j in np.flatnonzero(np.bitwise_count(values[i + 1 :] ^ values[i]) <= distance) + i + 1:
            root[find(int(j))] = find(i)
    return {int(v): find(i) for i, v in enumerate(values)}


def test_fingerprints_equal_plain(spark):
    rng = random.Random(3)
    texts = [None, "", " \t\n ", "One", "one two THREE", "a b c d", "É é É e f"] + [" ".join(rng.choice("abcdefgÉ") for _ in range(n)) for n in (5, 40, 400, 3000)]
    assert [SD.fingerprint(t) for t in texts] == [plain_fingerprint(t) for t in texts]
    assert SD.fingerprint(texts[-1], step=7) == plain_fingerprint(texts[-1])
    native = spark.createDataFrame([("one two three four",)], "t string").selectExpr("xxhash64(t) AS h").first()["h"]
    assert SD.fingerprint("one two three four") == native % 2**64


def test_each_word_has_one_home_and_close_words_meet_there():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2**64, 4000, dtype=np.uint64)
    y = x.copy()
    for _ in range(4):
        y ^= np.uint64(1) << rng.integers(0, 64, len(x), dtype=np.uint64)
    met = np.zeros(len(x), dtype=bool)
    for part in range(3):
        row, anchor, home = SD.anchors(x, part, 4)
        assert np.bincount(row[home], minlength=len(x)).tolist() == [1] * len(x)
        homes = dict(zip(row[home], anchor[home], strict=True))
        for r, a in zip(*SD.anchors(y, part, 4)[:2], strict=True):
            met[r] |= homes[r] == a
    assert met.all()


@pytest.mark.parametrize("block_rows", [8192, 40])
def test_links_connect_what_all_pairs_connect(spark, block_rows):
    rng = np.random.default_rng(block_rows)
    base = rng.integers(0, 2**64, 400, dtype=np.uint64)
    base[:3] = [0, 2**64 - 1, 1]
    near = np.repeat(base[:60], 12)
    for _ in range(3):
        near ^= np.where(rng.random(len(near)) < 0.8, np.uint64(1) << rng.integers(0, 64, len(near), dtype=np.uint64), np.uint64(0))
    values = np.unique(np.concatenate([base, near]))
    classes = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "fp long")
    found = SD.components(SD.links(classes, 4, block_rows)).collect()
    mine = {int(v): int(v) for v in values} | {r["node"] % 2**64: r["root"] % 2**64 for r in found}
    want = plain_components(values.tolist())
    assert len(set(mine.values())) == len(set(want.values())) == len({(mine[v], want[v]) for v in want})


def test_simhash_groups_documents(spark):
    rng = random.Random(5)
    long_text = " ".join(rng.choice(["lorem", "ipsum", "dolor", "sit", "amet"]) + str(rng.randrange(90)) for _ in range(3000))
    docs = [(3, long_text), (9, long_text + " end"), (8, long_text.upper()), (4, None), (5, ""), (2, "  "), (6, "one two"), (6, "one two"), (None, "all alone here"), (1, "something else altogether, and more of it")]
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, fp string")
    got = collections.Counter(tuple(r) for r in SD.simhash_duplicates(df).collect())
    want = plain_components([plain_fingerprint(t) for _, t in docs])
    least = collections.defaultdict(list)
    for d, t in docs:
        least[want[plain_fingerprint(t)]].append(d)
    low = {k: min((x for x in v if x is not None), default=None) for k, v in least.items()}
    assert got == collections.Counter((d, f"{plain_fingerprint(t):016x}", low[want[plain_fingerprint(t)]]) for d, t in docs)
    assert SD.simhash_duplicates(df.limit(0)).count() == 0


def test_simhash_query_equals_all_pairs(spark):
    rows = table(spark, SF, "documents").select("doc_id", "text").collect()
    prints = {r["doc_id"]: plain_fingerprint(r["text"]) for r in rows}
    groups = plain_components(prints.values())
    least = {}
    for d in sorted(prints):
        least.setdefault(groups[prints[d]], d)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in Q.op13_simhash_near_dedup(spark, SF).collect()}
    assert got == {d: (f"{p:016x}", least[groups[p]]) for d, p in prints.items()}


@pytest.mark.parametrize("name", ["op11_prefix_trie", "op12_importance_resampling"])
def test_query_equals_sql(spark, name):
    df = Q.QUERIES[name](spark, SF)
    names, want = oracle_rows(connect(SF), Q.ORACLE_SQL[name])
    assert sorted(df.columns) == names and rows_of(df) == want
