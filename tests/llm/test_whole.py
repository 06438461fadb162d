"""Whole queries against plain Python: language identification, and the pipeline from raw text to token ids."""

import bisect
import math
import random
import re
from collections import Counter

import numpy as np
import tiktoken

import corpus_pipeline
from lorewell.llm import langid, mixing, packing, toxicity
from lorewell.llm.shingles import MIX

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
FULL = (1 << 64) - 1
M0, M1, M2 = (int(x) for x in MIX)


def mixed(x):
    x = (x + M0) & FULL
    x = ((x ^ (x >> 30)) * M1) & FULL
    x = ((x ^ (x >> 27)) * M2) & FULL
    return x ^ (x >> 31)


def cut(text):
    return re.sub(langid.UNSPACED, r" \1 ", text or "").split()


def run_of(word):
    letters = [c for c in word.lower() if c.isalpha()]
    return [1, *map(ord, letters), 2], letters


def script_of(letters):
    at = bisect.bisect_right([a for a, _ in langid.SCRIPT_RANGES], ord(letters[0])) - 1
    return langid.SCRIPT_RANGES[at][1]


def buckets(run):
    for n in range(1, langid.LONGEST + 1):
        for i in range(len(run) - n + 1):
            h = 0
            for x in run[i : i + n]:
                h = (h * M1 + x) & FULL
            yield mixed((h + n * M2) & FULL) >> 49


def brute_languages(rows, learned):
    """lang_pred and score of every row, learned from those that ``learned`` is true for."""
    grams, scripts = {}, {}
    for i, text, lang in rows:
        if lang is None or not learned(i):
            continue
        grams.setdefault(lang, Counter())
        scripts.setdefault(lang, Counter())
        for word in cut(text):
            run, letters = run_of(word)
            if letters:
                grams[lang].update(buckets(run))
                scripts[lang][script_of(letters)] += 1
    languages = sorted(grams)
    total = {x: sum(grams[x].values()) + 0.5 * langid.BUCKETS for x in languages}
    writes = {x: {s for s, n in scripts[x].items() if n >= 0.01 * sum(scripts[x].values())} for x in languages}
    out = {}
    for i, text, _ in rows:
        words = []
        for word in cut(text):
            run, letters = run_of(word)
            able = [x for x in languages if letters and script_of(letters) in writes[x]]
            score = {x: sum(math.log((grams[x][b] + 0.5) / total[x]) for b in buckets(run)) / 2 for x in able}
            top = max(score.values(), default=0.0)
            words.append((bool(letters), [(max(score[x] - top, -12.0) if x in score else -12.0) if able else 0.0 for x in languages], bool(able)))
        if not any(w[0] for w in words):
            out[i] = ("und", 0.0)
            continue
        value, back = [0.0] * len(languages), []
        for t, (_, s, _) in enumerate(words):
            best = max(range(len(languages)), key=lambda k: value[k])
            origin = [best if t and value[k] < value[best] - 8.0 else k for k in range(len(languages))]
            value = [(max(value[k], value[best] - 8.0) if t else 0.0) + s[k] for k in range(len(languages))]
            back.append(origin)
        k, path = max(range(len(languages)), key=lambda k: value[k]), []
        for origin in reversed(back):
            path.append(k)
            k = origin[k]
        votes = Counter(p for p, w in zip(reversed(path), words, strict=True) if w[2])
        if votes:
            best = max(range(len(languages)), key=lambda k: votes[k])
            out[i] = (languages[best], votes[best] / sum(votes.values()))
        else:
            out[i] = (max(languages, key=lambda x: sum(scripts[x].values())), 0.0)
    return out


def test_languages_of_whole_texts_are_those_of_plain_python(spark):
    rng = random.Random(4)
    of = {"en": ["the", "house", "with", "that", "though", "night", "it's"], "de": ["und", "nicht", "schon", "über", "Zwischen", "straße"], "ru": ["дом", "ночь", "и", "хорошо"], "ja": ["家", "夜の", "として", "カメラ"]}
    rows = []
    for i in range(60):
        lang = rng.choice(sorted(of))
        words = rng.choices(of[lang], k=rng.randint(1, 25))
        if i % 4 == 0:
            words += rng.choices(of[rng.choice(sorted(of))], k=rng.randint(1, 20))
        rows.append((i, " ".join(words) + rng.choice(["", " 12 !", "\n…"]), lang if i % 7 else None))
    rows += [(100, None, "en"), (101, "", "de"), (102, "12 – !", None), (103, "ελληνικά λόγια", None), (104, "x", "en")]
    df = spark.createDataFrame([(i, t, x, "s", 0) for i, t, x in rows], DOCS)
    learned = lambda i: i % 3 != 1
    model = langid.fit(df.where("doc_id % 3 <> 1"))
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(df, model).collect()}
    want = brute_languages(rows, learned)
    assert {i: x for i, (x, _) in got.items()} == {i: x for i, (x, _) in want.items()}
    assert all(abs(got[i][1] - want[i][1]) < 1e-6 for i in got)


def test_pipeline_gives_what_a_plain_chain_gives(spark, tmp_path):
    rng = random.Random(6)
    words = [a + b for a in ("ba", "ke", "li", "mo", "nu", "sa") for b in ("ran", "stel", "dor", "mik")]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    item = say(12)
    texts = {i: say(rng.randint(1, 120)) for i in range(120)}
    for i in range(0, 120, 4):
        texts[i] += " grumblefax zorgnaster"
    for i in range(120, 135):
        texts[i] = texts[i - 100] + (" end" if i % 2 else "")
    texts |= {140: say(20) + " " + item + " " + say(9), 141: "", 142: None, 143: say(3000)}
    rows = [(i, t, "en", "abc"[i % 3] if i % 5 else None, 0) for i, t in texts.items()]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(0, 120, 2)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    docs, labels = spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/labels.parquet")
    held_out = "coalesce(crc32(cast(doc_id as string)) % 4 = 2, false)"
    model = toxicity.fit(docs, labels.where(f"not {held_out}"))
    seen = toxicity.WordScores(model.weights.astype(np.float32).tolist())
    left = {i: t for i, t in texts.items() if toxicity.ToxicityModel(model.weights.astype(np.float32), model.bias).score(t, seen) < 0.3}

    def shingles(text):
        w = [x.translate({c: c + 32 for c in range(65, 91)}) for x in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    sets, label = {i: shingles(t) for i, t in left.items()}, {i: i for i in left}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and label[a] < label[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    label[b], changed = label[a], True
    left = {i: t for i, t in left.items() if label[i] == i}
    left = {i: t for i, t in left.items() if item not in (t or "")}
    kept = spark.createDataFrame([r for r in rows if r[0] in left], DOCS)
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix_sources(corpus_pipeline._keyed(kept).selectExpr("doc.doc_id", "doc.text", "doc.source")).collect()}
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    encoding = tiktoken.Encoding("own", pat_str=packing.PATTERN, mergeable_ranks=packing.load_vocabulary(f"{corpus_pipeline.TOKENIZERS}/byte_bpe_50k.tiktoken"), special_tokens={})
    pieces, ids = {}, Counter()
    for r in got:
        row, ends = np.frombuffer(bytes(r["input_ids"]), "<u2"), r["cu_seqlens"]
        assert len(row) == 2048 and (row[ends[-1] :] == 50256).all()
        for doc, piece, a, b in zip(r["doc_ids"], r["pieces"], ends, ends[1:], strict=False):
            pieces.setdefault((doc, piece), []).append(tuple(row[a:b].tolist()))
            ids[doc, piece] += 1
    # every document that a plain chain keeps, with all of its tokens, as often as its source asks for; nothing else
    sources = {r[0]: r[3] for r in rows}
    for i in left:
        tokens = [*encoding.encode_ordinary(left[i] or ""), 50256] if left[i] else []
        for piece, at in enumerate(range(0, len(tokens), 2048)):
            assert set(pieces.get((i, piece), [])) <= {tuple(tokens[at : at + 2048])} and ids[i, piece] <= 2
            assert ids[i, piece] == ids[i, 0]
    assert {d for d, _ in pieces} <= {i for i, t in left.items() if t}
    size = lambda i: len((left[i] or "").split())
    for source in {sources[i] for i in left}:
        own = [i for i in left if sources[i] == source]
        made, meant = sum(size(i) * ids[i, 0] for i in own), sum(size(i) * copies[i] for i in own)
        assert abs(made - meant) <= 2 * max(size(i) for i in own)
