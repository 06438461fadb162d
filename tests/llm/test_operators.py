"""Operators against brute force, exact round trips and held-out rows."""

import hashlib
import random
import re
import string

import numpy as np
import pytest
import tiktoken
from pyspark.sql import functions as F

from lorewell.llm import decontam, langid, lm_score, minhash, mixing, packing, quality, suffix_dedup, toxicity, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [a + b for a in ("ba", "ke", "li", "mo", "nu", "sa", "te", "vi") for b in ("ran", "stel", "dor", "mik", "pun")]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def frame(spark, texts, source="s"):
    return spark.createDataFrame([(i, t, "en", source, len(t or "")) for i, t in enumerate(texts)], DOCS)


def test_decontamination_finds_what_brute_force_finds(spark):
    rng = random.Random(1)
    items = [prose(rng, n) for n in (3, 6, 12, 40, 80)]
    texts = [prose(rng, 400) for _ in range(8)]
    texts[1] += " " + items[3].upper().replace(" ", ", ")
    texts[2] = items[2] + "\n" + texts[2]
    texts[3] = texts[3][:300] + " " + " ".join(items[4].split()[:70]) + " " + texts[3][300:]
    texts[4] = items[0]
    texts[5] += " " + " ".join(items[4].split()[:30])

    def shingles(t):
        w = re.findall(r"[^\W_]+", t.lower())
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}

    def found(t, x):
        w, i = (re.findall(r"[^\W_]+", y.lower()) for y in (t, x))
        if len(i) < 5:
            return any(w[a : a + len(i)] == i for a in range(len(w)))
        return 100 * len(shingles(t) & shingles(x)) >= 80 * len(shingles(x))

    texts[6] += " " + items[0] + " " + prose(rng, 3)
    want = {(d, i) for d, t in enumerate(texts) for i, x in enumerate(items) if found(t, x)}
    own = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(frame(spark, texts), own).collect()}
    assert got == want and {(1, 3), (2, 2), (3, 4), (4, 0), (6, 0)} <= got and (5, 4) not in got


def test_toxicity_reaches_misspellings(spark):
    rng = random.Random(2)
    texts, labels = [], []
    for i in range(240):
        bad = i % 2
        texts.append(prose(rng, 30) + (" grumblefax zorgnaster " if bad else " ") + prose(rng, 30))
        labels.append((i, bad))
    model = toxicity.fit(frame(spark, texts), spark.createDataFrame(labels, "doc_id long, toxic int"))
    new = [prose(rng, 60), prose(rng, 40) + " grumblefaxx zorgnastr", None, "", "  "]
    rows = toxicity.score(frame(spark, new), model).orderBy("doc_id").collect()
    assert [r["predicted"] for r in rows[:2]] == [0, 1]
    assert rows[2]["score"] == rows[3]["score"] == rows[4]["score"] and all(0 <= r["score"] <= 1 for r in rows)
    kept = {r["doc_id"] for r in toxicity.without_toxic(frame(spark, new), model).collect()}
    assert kept == {r["doc_id"] for r in rows if r["predicted"] == 0}
    none = toxicity.fit(frame(spark, texts), spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r["predicted"] for r in toxicity.score(frame(spark, new), none).collect()} == {0}


def test_toxicity_scores_are_those_of_brute_force(spark):
    rng = random.Random(18)
    texts = [prose(rng, rng.randint(5, 300)) + (" grumblefax" if i % 3 == 0 else "") for i in range(90)]
    model = toxicity.fit(frame(spark, texts), spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(60)], "doc_id long, toxic int"))
    got = {r["doc_id"]: r["score"] for r in toxicity.score(frame(spark, texts), model).collect()}
    for i, t in enumerate(texts):
        words, best = t.split(), -np.inf
        n = max(1, len(words) // 64)
        for k in range(n):
            bag = set(words[k * len(words) // n : (k + 1) * len(words) // n])
            each = [np.mean([model.weights[b] for b in toxicity.subwords(w)]) for w in bag]
            best = max(best, sum(each) / max(32, len(bag)))
        assert got[i] == pytest.approx(1 / (1 + np.exp(-(model.bias + best))), abs=1e-6)


def test_packing_is_lossless(spark, tmp_path):
    path = "/opt/tokenizers/byte_bpe_50k.tiktoken"
    ranks = packing.load_vocabulary(path)
    encoding = tiktoken.Encoding("t", pat_str=packing.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(3)
    texts = [prose(rng, n) for n in (1, 5, 30, 300, 2, 17)] + ["", None, "ünï 漢字 \n\n x"]
    rows = packing.pack_documents(frame(spark, texts), path, length=64).collect()
    found = {}
    for r in rows:
        ids, places, cuts = np.frombuffer(bytes(r["input_ids"]), "<u2"), np.frombuffer(bytes(r["position_ids"]), "<u2"), r["cu_seqlens"]
        assert len(ids) == len(places) == 64 and cuts[0] == 0 and cuts[-1] == r["n_tokens"] <= 64
        for doc, piece, a, b in zip(r["doc_ids"], r["pieces"], cuts, cuts[1:], strict=False):
            assert places[a:b].tolist() == list(range(b - a))
            found[doc, piece] = ids[a:b].tolist()
    for i, t in enumerate(texts):
        tokens = [x for _, part in sorted((k[1], v) for k, v in found.items() if k[0] == i) for x in part]
        assert tokens == (encoding.encode_ordinary(t) + [50256] if t else [])


def test_best_fit_decreasing_takes_the_fullest_row():
    for seed in range(20):
        rng = random.Random(seed)
        sizes = [rng.randint(1, 50) for _ in range(60)]
        rows, free = [], []
        for i in sorted(range(60), key=lambda i: -sizes[i]):
            fit = [f for f in free if f >= sizes[i]]
            at = free.index(min(fit)) if fit else None
            if at is None:
                rows.append([i])
                free.append(50 - sizes[i])
            else:
                rows[at].append(i)
                free[at] -= sizes[i]
        got = packing.best_fit_decreasing(sizes, 50)
        assert sorted(x for r in got for x in r) == list(range(60)) and all(sum(sizes[x] for x in r) <= 50 for r in got)
        assert sorted(50 - sum(sizes[x] for x in r) for r in got) == sorted(free)


def targets_by_rounds(sizes):
    """The excess is given to the others by weight, round after round."""
    names = sorted(k for k in sizes if k is not None) + ([None] if None in sizes else [])
    weight = {k: (5, 2, 1)[i % 3] for i, k in enumerate(names)}
    rest, fixed = 1.5 * sum(sizes.values()), {}
    while True:
        open_ = [k for k in names if k not in fixed]
        level = {k: rest * weight[k] / sum(weight[o] for o in open_) for k in open_} if open_ else {}
        over = [k for k in open_ if level[k] > 2 * sizes[k]]
        if not over:
            return fixed | level
        for k in over:
            fixed[k] = 2.0 * sizes[k]
            rest -= fixed[k]


def test_mixing_meets_its_targets(spark):
    rng = random.Random(4)
    rows = [(i, prose(rng, rng.randint(1, 60)), "en", rng.choice(["a", "a", "a", "b", "c", None]), 0) for i in range(900)] + [(900, None, "en", "a", 0), (901, " \t", "en", "d", 0)]
    docs = spark.createDataFrame(rows, DOCS)
    got = mixing.mix_sources(docs, fanout=16).collect()
    again = {r["doc_id"]: r["taken"] for r in mixing.mix_sources(docs, fanout=16).collect()}
    assert len(got) == len(rows) and again == {r["doc_id"]: r["taken"] for r in got}
    sizes = {}
    for r in got:
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
    want = targets_by_rounds(sizes)
    for s, target in want.items():
        own = [r for r in got if r["source"] == s]
        assert all(abs(r["target"] - target) < 1e-6 for r in own)
        assert abs(sum(r["taken"] for r in own) - target) <= 60
        assert all(r["taken"] <= 2 * r["size"] and r["taken"] == r["copies"] * r["size"] for r in own)


def test_mixing_rows_alike(spark):
    rng = random.Random(14)
    same = [(None, "one two three four", "en", "a", 0)] * 301 + [(7, "five six", "en", "b", 0)] * 200
    rows = same + [(None, prose(rng, rng.randint(1, 9)), "en", "a", 0) for _ in range(300)] + [(i, prose(rng, 5), "en", "b", 0) for i in range(200)] + [(None, "", "en", "b", 0), (None, None, "en", None, 0)]
    got = mixing.mix_sources(spark.createDataFrame(rows, DOCS), fanout=8).collect()
    assert len(got) == len(rows) and all(r["copies"] == 1 and r["taken"] == 0 for r in got if r["size"] == 0)
    for s in ("a", "b"):
        own = [r for r in got if r["source"] == s and r["size"]]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 20 and all(r["taken"] <= 2 * r["size"] for r in own)


@pytest.mark.parametrize("per_gram", [200, 0])
def test_repeated_strings_of_full_length(spark, per_gram):
    """Strings of 200 bytes; a passage of many documents between words of their own, its parts, and copies."""
    rng = random.Random(15)
    word = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage = word(420)
    texts = [word(rng.randint(0, 300)) + passage[rng.choice((0, 0, 37, 150)) :][: rng.choice((420, 420, 260, 199, 200))] + word(rng.randint(0, 300)) for _ in range(50)]
    texts += [texts[0], texts[0], passage * 2, word(5000)]
    data = [t.encode() for t in texts]
    seen = {}
    for t in data:
        for a in range(len(t) - 199):
            seen[t[a : a + 200]] = seen.get(t[a : a + 200], 0) + 1
    plain, lost = suffix_dedup.repeated_strings(frame(spark, texts), per_gram=per_gram)
    got = {r["doc_id"]: r for r in plain.join(lost, "doc", "left").collect()}
    for i, t in enumerate(data):
        gone = np.zeros(len(t), bool)
        for a in range(len(t) - 199):
            if seen[t[a : a + 200]] > 1:
                gone[a : a + 200] = True
        left = bytes(np.frombuffer(t, np.uint8)[~gone])
        assert (got[i]["kept_sha256"] or got[i]["sha256"]) == hashlib.sha256(left).hexdigest() and (got[i]["n_removed"] or 0) == gone.sum()


@pytest.mark.parametrize("per_gram", [200, 0])
def test_repeated_strings_are_removed(spark, per_gram):
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abcdef") for _ in range(n))
    shared = [word(n) for n in (19, 20, 21, 60, 200)]
    texts = [word(rng.randint(0, 80)) + "".join(rng.choice(shared) + word(rng.randint(0, 30)) for _ in range(rng.randint(0, 3))) for _ in range(60)]
    texts += ["x" * 100, "y" * 20, "y" * 20, "", None, "é" * 30, shared[4] * 2]
    data = [(t or "").encode() for t in texts]
    starts = {}
    for i, t in enumerate(data):
        for a in range(len(t) - 19):
            starts.setdefault(t[a : a + 20], []).append((i, a))
    plain, lost = suffix_dedup.repeated_strings(frame(spark, texts), length=20, gram=10, per_gram=per_gram)
    got = {r["doc_id"]: r for r in plain.join(lost, "doc", "left").collect()}
    for i, t in enumerate(data):
        gone = np.zeros(len(t), bool)
        for a in range(len(t) - 19):
            if len(starts[t[a : a + 20]]) > 1:
                gone[a : a + 20] = True
        left = bytes(np.frombuffer(t, np.uint8)[~gone])
        r = got[i]
        assert r["n_bytes"] == len(t) and (r["n_removed"] or 0) == gone.sum() and (r["n_spans"] or 0) == len(suffix_dedup.runs(gone))
        assert (r["kept_sha256"] or r["sha256"]) == hashlib.sha256(left).hexdigest()


def test_suffix_levels_grow_geometrically():
    rng = np.random.default_rng(0)
    levels, rows = suffix_dedup.SuffixLevels(4), rng.integers(97, 100, (900, 4)).astype(np.uint8)
    for at in range(0, 900, 50):
        levels.add(rows[at : at + 50])
    keys = [bytes(r) for r in rows]
    assert levels.repeated.tolist() == [keys.count(k) > 1 for k in keys]
    assert len(levels.levels) <= 6 and sum(len(k) for k, _ in levels.levels) == 900


@pytest.mark.parametrize("k", [4, 5])
def test_near_duplicates_are_those_of_brute_force(spark, k):
    rng = random.Random(6)
    texts = [prose(rng, 120) for _ in range(12)]
    for i in range(40):
        w = texts[rng.randrange(len(texts))].split()
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(len(w))] = rng.choice(WORDS)
        texts.append(" ".join(w))
    texts += [texts[0].upper(), "one two", "ONE\ttwo", "", None, " "]

    def shingles(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())

    sets, root = [shingles(t) for t in texts], list(range(len(texts)))
    find = lambda i: i if root[i] == i else find(root[i])
    for a in range(len(texts)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    got = {r["doc_id"]: r for r in minhash.near_duplicates(frame(spark, texts), k=k).collect()}
    assert {i: got[i]["component_id"] for i in got} == {i: find(i) for i in range(len(texts))}
    assert all(r["n_shingles"] == len(sets[i]) and r["kept"] == (r["component_id"] == i) for i, r in got.items())


def test_families_of_near_misses_keep_every_link(spark):
    """Form letters of every similarity: many pairs miss the threshold closely, none may be lost or made up."""
    rng = random.Random(16)
    base, texts = prose(rng, 100).split(), []
    for i in range(120):
        w = list(base)
        for at in rng.sample(range(100), rng.randint(0, 9)):
            w[at] = f"{rng.choice(WORDS)}{i % 7}"
        texts.append(" ".join(w))
    sets = [{tuple(t.split()[i : i + 5]) for i in range(96)} for t in texts]
    linked = [[100 * len(a & b) >= 80 * len(a | b) for b in sets] for a in sets]
    root = list(range(120))
    for _ in range(120):
        root = [min(root[b] for b in range(120) if linked[a][b]) for a in range(120)]
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(frame(spark, texts)).collect()}
    assert [got[i] for i in range(120)] == root and 3 < len(set(root)) < 110


def test_pseudo_likelihood_prefers_the_corpus(spark):
    rng = random.Random(7)
    docs = frame(spark, ["the cat sat on the mat and the dog ran to the old house " * 3 for _ in range(60)] + ["mat old the the on cat to sat house and ran dog the the " * 3, "qzx vbn wer", "", None])
    got = {r["doc_id"]: r for r in lm_score.pseudo_likelihood(docs).collect()}
    assert got[0]["mean_log_prob"] > got[60]["mean_log_prob"] > got[61]["mean_log_prob"]
    assert got[62]["n_tokens"] == got[63]["n_tokens"] == 0 and got[62]["mean_log_prob"] is None and got[62]["log_prob"] == 0
    assert got[0]["log_prob"] == pytest.approx(got[1]["log_prob"]) and rng


def test_rare_words_keep_their_own_counts(spark):
    filler = [a + b + c + d for a in "bcdfghjklm" for b in "aeiou" for c in WORDS for d in "pqrstvwxyzn"]
    assert len(set(filler)) > 20_000
    docs = frame(spark, [" ".join(filler[i : i + 500]) for i in range(0, len(filler), 500)] * 3 + ["zzaqx", "zzaqx", "zzbqx", None])
    got = {r["doc_id"]: r["log_prob"] for r in lm_score.pseudo_likelihood(docs).collect()}
    a, _, b, _ = sorted(got)[-4:]
    assert got[a] - got[b] == pytest.approx(np.log(2), abs=1e-4)


def test_units_follow_the_vocabulary_and_their_words_sum_to_one(spark):
    words = [a + b + c for a in WORDS for b in WORDS for c in "bdfh"]
    docs = frame(spark, [" ".join(words[: 10 * i]) for i in range(1, 641)] + ["a b c", None])
    units, counts = lm_score.corpus_units(docs, vocabulary=100)
    sums, n = np.zeros(units.size), {r["word"]: r["n"] for r in counts.collect()}
    for w, k in n.items():
        sums[units.unit(w)] += 1 if w in units.top else k / units.tokens[units.unit(w)]
        assert w not in units.inside or np.exp(units.inside[w]) == pytest.approx(k / units.tokens[units.unit(w)])
    assert sums[units.tokens > 0] == pytest.approx(1) and not sums[units.tokens <= 0].any()
    assert len(units.top) == int(np.ceil(8 * len(n) ** 0.5)) > 64 and units.classes == int(np.ceil(2 * len(n) ** 0.5))
    net, rng = lm_score.Network(units.size), np.random.default_rng(2)
    x = np.tile(rng.integers(0, units.size + 1, 4), (units.size, 1))
    assert np.exp(net.log_probs(x, np.arange(units.size)).astype(float)).sum() == pytest.approx(1, abs=1e-4)


def test_scores_are_the_sums_of_brute_force(spark):
    rng = random.Random(17)
    texts = [prose(rng, rng.randint(1, 40)) for _ in range(60)] + ["", None, "ba"]
    docs = frame(spark, texts)
    units, counts = lm_score.corpus_units(docs, vocabulary=10)
    coded = lm_score.encoded(docs, units).withColumn("row", F.monotonically_increasing_id()).cache()
    net = lm_score.train(coded, units)
    got, n = {r["doc_id"]: r for r in lm_score.score(coded, net, counts).collect()}, {r["word"]: r["n"] for r in counts.collect()}
    e, b, w, c, v, d = (x.astype(float) for x in net.parts(net.vector))
    soft = lambda z: np.exp(z - z.max()) / np.exp(z - z.max()).sum()
    for i, t in enumerate(texts):
        words = (t or "").split()
        us, want = [units.unit(x) for x in words], 0.0
        for k, x in enumerate(words):
            around = [us[k + s] if 0 <= k + s < len(us) else units.size for s in lm_score.SIDES]
            h = np.maximum(sum(e[j][a] for j, a in enumerate(around)) + b, 0)
            g, m = divmod(us[k], net.per)
            own = 1 if x in units.top else n[x] / units.tokens[us[k]]
            want += np.log(soft(w @ h + c)[g] * soft(v[g] @ h + d[g])[m] * own)
        assert got[i]["n_tokens"] == len(words) and got[i]["log_prob"] == pytest.approx(want, rel=1e-4, abs=1e-6)
    again = lm_score.pseudo_likelihood(docs.repartition(3)).collect()
    once = {r["doc_id"]: r["log_prob"] for r in lm_score.pseudo_likelihood(docs).collect()}
    assert all(r["log_prob"] == pytest.approx(once[r["doc_id"]], rel=1e-5) for r in again)


def test_network_gradient_is_that_of_its_loss():
    net, rng = lm_score.Network(6, width=3), np.random.default_rng(1)
    x, y = rng.integers(0, 7, (20, 4)), rng.integers(0, 6, 20)
    net.vector = net.vector.astype(np.float64)
    g = net.gradient(x, y)
    for i in rng.integers(0, len(g), 25):
        old, e = net.vector[i], 1e-4
        net.vector[i] = old + e
        up = -net.log_probs(x, y).mean()
        net.vector[i] = old - e
        down = -net.log_probs(x, y).mean()
        net.vector[i] = old
        assert g[i] == pytest.approx((up - down) / (2 * e), abs=2e-3)


def test_warc_round_trip(spark, tmp_path):
    big, rng = "<p>" + "z" * 1200 + "</p>", random.Random(8)
    pages = [(1, "http://a/1", big), (5, "http://a/5", big), (3, None, big), (7, "u", "small"), (8, "u", "small"), (9, "u\r\nx", None), (10, "u", "é\r\n\r\n" + "".join(rng.choice(string.printable) for _ in range(5000)))]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    path = f"file://{tmp_path}/w"
    warc.write_archives(df.repartition(2), path, per_file=3)
    rows = {r["page_id"]: r for r in warc.read_archives(spark, path).collect()}
    assert {k: (r["record_type"], r["refers_to"]) for k, r in rows.items() if k in (1, 3, 5)} == {1: ("revisit", 5), 3: ("revisit", 5), 5: ("response", None)}
    for i, _, html in pages:
        data, r = (html or "").encode(), rows[i]
        assert r["payload_bytes"] == len(data) and r["payload_digest"] == hashlib.sha1(data).hexdigest() and r["verified"]
        assert r["record_type"] == "revisit" or bytes(r["payload"]) == data


def test_warc_takes_large_pages(spark, tmp_path):
    rng = np.random.default_rng(3)
    noise = rng.integers(32, 127, 24_000_000).astype(np.uint8).tobytes().decode()
    df = spark.createDataFrame([(1, "u", noise), (2, "u", "x" * 17_000_000), (3, "u", "x" * 17_000_000), (4, "u", "s")], "page_id long, url string, html string")
    path = f"file://{tmp_path}/big"
    warc.write_archives(df, path, file_bytes=20_000_000)
    rows = {r["page_id"]: r for r in warc.read_archives(spark, path, with_payload=False).collect()}
    assert {k: (r["payload_bytes"], r["record_type"], r["verified"]) for k, r in rows.items()} == {1: (24_000_000, "response", True), 2: (17_000_000, "revisit", True), 3: (17_000_000, "response", True), 4: (1, "response", True)}


def test_warc_notices_damage(tmp_path):
    good = warc.member(warc.record(1, "u", b"hello", hashlib.sha1(b"hello").hexdigest(), None))
    assert [warc.parse_record(m)["block"][-5:] for m in warc.members_of(good + good)] == [b"hello"] * 2
    with pytest.raises(ValueError):
        list(warc.members_of(good[:-9]))


def test_language_spans(spark):
    rng = random.Random(9)
    en, de = ["the", "house", "with", "that", "though", "night"], ["und", "nicht", "schon", "über", "zwischen", "straße"]
    say = lambda words, n: " ".join(rng.choice(words) for _ in range(n))
    rows = [(i, say(en if i % 3 == 0 else de, 40) if i % 3 < 2 else "дом и ночь " * 9, ("en", "de", "ru")[i % 3], "s", 0) for i in range(90)]
    docs = spark.createDataFrame(rows, DOCS)
    model = langid.fit(docs.where("doc_id >= 30"))
    got = {r["doc_id"]: r for r in langid.identify(docs, model).collect()}
    assert all(got[i]["lang_pred"] == ("en", "de", "ru")[i % 3] for i in range(30))
    assert [x for x, _ in langid.spans(say(en, 20) + " " + say(de, 20) + " дом и ночь ночь", model)] == ["en", "de", "ru"]
    odd = langid.identify(frame(spark, [None, "", "12 34 !", "漢字漢字"]), model).orderBy("doc_id").collect()
    assert [r["lang_pred"] for r in odd[:3]] == ["und"] * 3 and odd[3]["lang_pred"] in model.languages


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(2)
    for _ in range(20):
        s = rng.normal(0, 3, (6, 3))
        best = max(np.ndindex(*[3] * 6), key=lambda p: sum(s[i, c] for i, c in enumerate(p)) - 2.0 * sum(a != b for a, b in zip(p, p[1:])))
        assert langid.viterbi(s, np.array([6]), 2.0).tolist() == list(best)


def test_quality_counts(spark):
    rng = random.Random(10)
    texts = [prose(rng, rng.randint(0, 60)) + rng.choice(["", "\n\nab cd ef\nab cd ef", " # $ <a>", " x y z w v x y z w v x y z w v", " q \x0b w"]) for _ in range(60)] + ["", None, "a a a a a a a a a a a a", "\n\n \n"]
    got = {r["doc_id"]: r for r in quality.quality_verdicts(frame(spark, texts)).collect()}
    for i, t in enumerate(texts):
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        grams = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
        covered = {k + j for k, g in enumerate(grams) if grams.count(g) > 1 for j in range(5)}
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered))
        assert r["base_failed"] == (len(w) < 10 or 100 * len(covered) > 20 * len(w)) and not (r["base_failed"] and r["kept"])


def test_quality_verdicts_are_those_of_brute_force(spark):
    """Expectation-maximisation over rows instead of patterns, with the same start and end."""
    rng = random.Random(13)
    texts = [". ".join(prose(rng, 12).capitalize() for _ in range(4)) for _ in range(40)] + [" ".join(rng.choice(["$$", "!!!", "#", "NOW", "12", "ba ke"]) + str(k) for k in range(30)) for _ in range(20)]
    texts += ["", None, "a b c"]
    rows = quality.quality_verdicts(frame(spark, texts)).collect()
    names = [f"vote_{k}" for k in quality.rules()]
    votes = np.array([[r[n] for n in names] for r in rows if not r["base_failed"]])
    bad, before = np.where(votes.min(axis=1) == quality.BAD, 0.8, 0.05), 0.0
    for _ in range(13):
        total, moved = (bad.sum(), len(votes) - bad.sum()), abs(bad.sum() - before)
        good = (total[1] + 1) / (len(votes) + 2)
        p = [np.array([[(w[votes[:, j] == v].sum() + 1) / (w.sum() + 3) for v in range(3)] for j in range(len(names))]) for w in (bad, 1 - bad)]
        at = np.arange(len(names))
        odds = np.log(good / (1 - good)) + np.log(p[1][at, votes] / p[0][at, votes]).sum(axis=1)
        before, bad = bad.sum(), 1 - 1 / (1 + np.exp(-odds))
        if moved <= 1e-4 * len(votes):
            break
    assert [r["quality"] for r in rows if not r["base_failed"]] == pytest.approx((1 - bad).tolist(), abs=1e-9)
    assert all(r["kept"] == (not r["base_failed"] and r["quality"] >= 0.5) for r in rows) and {r["kept"] for r in rows} == {True, False}


def test_quality_learns_from_votes(spark):
    rng = random.Random(11)
    clean = [". ".join(prose(rng, 12).capitalize() for _ in range(5)) for _ in range(80)]
    junk = [" ".join(rng.choice(["$$$", "!!!", "###", "BUY!!!", "NOW", "123456"]) + str(k) for k in range(40)) for _ in range(20)]
    got = {r["doc_id"]: r for r in quality.quality_verdicts(frame(spark, clean + junk)).collect()}
    assert all(got[i]["kept"] == (i < 80) for i in range(100))


def test_no_python_in_native_plans(spark):
    docs = frame(spark, ["a b c d e f g h i j k"] * 3)
    for df in (mixing.mix_sources(docs), quality.quality_verdicts(docs)):
        assert not re.search("Python|Pandas|Arrow", df._jdf.queryExecution().toString())
    assert F is not None
