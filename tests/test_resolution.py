"""Entity resolution against comparing all names."""

import random

from pyspark.sql import functions as F

from lorewell.operators import resolution as R

SCHEMA = "chunk_index long, record_index long, source_id string, src_id string, dst_id string, type string, description string, weight double"


def grams(form):
    p = f" {form} "
    return {p[i : i + 3] for i in range(max(1, len(p) - 2))}


def brute(names, percent=80):
    """Canonical names by all pairs of forms."""
    import re

    form = {n: re.sub(r"[\W_]+", " ", n).lower().strip() for n in names}
    own = {f: grams(f) for f in set(form.values()) if f}
    label = {f: f for f in own}
    changed = True
    while changed:
        changed = False
        for a in own:
            for b in own:
                if 100 * len(own[a] & own[b]) >= percent * len(own[a] | own[b]) and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    out = {}
    for n in set(names):
        same = [m for m in set(names) if (label[form[m]] == label[form[n]] if form[n] and form[m] else m == n)]
        out[n] = min(same, key=lambda m: (-names.count(m), m))
    return out


def test_names_are_resolved_as_all_pairs_would(spark):
    rng = random.Random(1)
    base = [" ".join(rng.choice(["North", "Harbour", "Steel", "Works", "Bank", "of", "Élan", "大学", "Union", "Trading"]) for _ in range(rng.randint(1, 4))) for _ in range(25)]
    names = []
    for b in base:
        for _ in range(rng.randint(1, 4)):
            x = list(b)
            if len(x) > 8 and rng.random() < 0.5:
                x[rng.randrange(len(x))] = rng.choice("aeiou")
            names += [rng.choice([str.upper, str.lower, str])("".join(x)).replace(" ", rng.choice([" ", "-", ", "]))] * rng.randint(1, 3)
    names += ["...", "!!", "a", "A", "ab"]
    df = spark.createDataFrame([(n,) for n in names] + [(None,)], "name string").repartition(3)
    assert {r["name"]: r["canonical"] for r in R.resolved(df).collect()} == brute(names)
    assert R.resolved(df.limit(0)).collect() == []


def test_a_crowd_of_alike_names_gives_few_links(spark):
    df = spark.range(400).select(F.format_string("the very long name of item number %03d", F.col("id")).alias("form"))
    links = R.alike(df)
    assert links.count() < 400 * 40  # all pairs are 79,800
    assert R.groups(links).select("label").distinct().count() == 1


def test_groups_follow_long_chains(spark):
    links = spark.range(0, 300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).unionByName(spark.createDataFrame([(1000, 1001)], "a long, b long"))
    found = {r["node"]: r["label"] for r in R.groups(links).collect()}
    assert found == {**dict.fromkeys(range(301), 0), 1000: 1000, 1001: 1000}
    assert R.groups(links.limit(0)).collect() == []


def test_relations_of_resolved_ends_are_merged(spark):
    rows = [(0, 0, "c0", "Acme Corp", "Bolt", "makes", "x", 2.0), (1, 0, "c1", "ACME corp", "Bolt", "sells", "y", 4.0), (2, 0, "c2", "acme-corp", "Acme Corp", "is", "z", 1.0), (3, 0, "c3", "Nut", "Nut", "is", "w", 1.0)]
    found = spark.createDataFrame(rows, SCHEMA)
    names = R.resolved(found.select(F.explode(F.array("src_id", "dst_id")).alias("name")))
    out = {(r["src_id"], r["dst_id"]): (r["type"], r["weight"], r["description"], r["source_id"]) for r in R.resolved_relations(found, names).collect()}
    assert out == {("Acme Corp", "Bolt"): ("makes", 3.0, "x\ny", ["c0", "c1"]), ("Nut", "Nut"): ("is", 1.0, "w", ["c3"])}
    people = found.select("chunk_index", "record_index", "source_id", F.col("src_id").alias("name"), "type", "description")
    assert {r["name"]: r["source_id"] for r in R.resolved_entities(people, names).collect()} == {"Acme Corp": ["c0", "c1", "c2"], "Nut": ["c3"]}
