"""The conversation trie against brute force, over ranges that cut conversations, and with odd rows."""

import hashlib
import random
import zlib

from pyspark.sql import functions as F

from lorewell.llm import trie
from lorewell.llm.scratch import Scratch

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    """Nodes from whole conversations held in a dict."""
    def digest(role, text):
        return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()

    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, digest(role or "", text or ""), role or "", text or ""))
    own = {c: [x[3:] for x in sorted(t)] for c, t in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = own.get(c - c % 5, [])[:h] + turns[h:]
    nodes = {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    out = []
    for key, members in nodes.items():
        below = {k: m for k, m in nodes.items() if k[: len(key)] == key}
        leaf = lambda k: not any(len(x) == len(k) + 1 and x[: len(k)] == k for x in nodes)
        saved = sum((len(m) - 1) * len(k[-1][1].encode()) for k, m in below.items() if k)
        over = sorted(c for c in members if len(built[c]) == len(key))
        children = sum(1 for k in below if len(k) == len(key) + 1)
        parent = min(nodes[key[:-1]]) if key else None
        out.append((min(members), len(key), parent, len(members), children, sum(map(leaf, below)), saved, hashlib.sha256(",".join(map(str, over)).encode()).hexdigest()))
    return sorted(out, key=str)


def found(spark, rows):
    df = trie.prefix_trie(spark.createDataFrame([(*r, 1, 2, "x") for r in rows], SCHEMA + ", depth int, n int, ids string").repartition(4))
    return sorted(map(tuple, df.collect()), key=str)


def test_trie_gives_what_brute_force_gives(spark):
    rng = random.Random(5)
    rows = []
    for c in range(60):
        if c % 9 == 4:
            continue
        n = rng.randint(1, 12)
        rows += [(c, t, rng.choice(["user", "bot"]), rng.choice(["hi", "hello", "größe"])) for t in range(n)]
    same = [(t, "user", f"turn {t}") for t in range(25)]  # copies, so a long shared path that no base explains
    rows += [(c, *x) for c in (100, 110, 120) for x in same] + [(130, *x) for x in same[:20]]
    assert found(spark, rows) == brute(rows)


def test_trie_takes_odd_rows(spark):
    rows = [(5, None, None, "a"), (5, 0, "user", None), (5, 0, "user", None), (5, 1, "", ""), (6, 0, "user", "b"), (None, 0, "user", "c"), (None, None, None, None), (7, 3, "user", "x" * 2_000_000)]
    rows += [(c, None, None, None) for c in (8, 9, 13)] + [(14, t, "user", "same") for t in (1, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1)]
    assert found(spark, rows) == brute(rows)
    assert found(spark, []) == [] and found(spark, [(None, 1, "user", "a")]) == []


def test_sums_run_across_ranges(spark):
    df = spark.createDataFrame([(i % 50 // 49, i, 1) for i in range(2000)], "c long, i long, x long").repartition(5)  # one key has nearly all rows
    got = trie.running(df, "c", [F.asc("i")], Scratch(spark, "test"), "sums", n=F.lit(1).cast("long"), s=F.col("i")).collect()
    for c in (0, 1):
        ids = [i for i in range(2000) if i % 50 // 49 == c]
        assert sorted((r["i"], r["n"], r["s"]) for r in got if r["c"] == c) == [(i, k + 1, sum(ids[: k + 1])) for k, i in enumerate(ids)]


def test_lists_of_ends_are_hashed_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(trie, "PIECE", 7)
    rows = [(c, 0, "user", "hi") for c in range(0, 500)]
    assert found(spark, rows) == brute(rows)
