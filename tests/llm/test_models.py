import math
import random
import re
import unicodedata
from collections import Counter
from zlib import crc32

import numpy as np
import pytest

from quillstack.llm import common, langid, lm, quality, seating
from quillstack.llm.common import Memo, setting

SF = "/root/testdata/sf0.01"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 0.5) for i, t in rows], "doc_id long, text string, lang string, score double")


def test_language_backoff_against_a_plain_reference():
    counts = {"a": Counter({"alpha": 5, "beta": 1}), "b": Counter({"gamma": 4, "beta": 3})}
    model = langid.LanguageModel.of_counts(counts)
    assert model.predict("alpha Alpha", Memo(model.unseen, 9))[0] == "a"
    assert model.predict("gamma, beta!", Memo(model.unseen, 9))[0] == "b"
    found = [g for g in langid.grams_of("alphq", 5) if g in model.grams]
    assert found == ["^alph"]
    assert model.unseen("alphq") == pytest.approx(model.gram_logs[model.grams["^alph"]])
    assert (model.unseen("日") == 0).all()
    for text in (None, "", "12 !? _", " \n"):
        assert model.predict(text, Memo(model.unseen, 9)) == ("und", 0.0)
    known = math.log((5 + 0.1) / (6 + 0.3)) - math.log(0.1 / (7 + 0.3))
    assert model.predict("alpha", Memo(model.unseen, 9))[1] == pytest.approx(1 / (1 + math.exp(-known)))


def test_language_held_out_accuracy(spark):
    got = langid.query(spark, SF).collect()
    want = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    held = [r for r in got if r.held_out]
    assert len(got) == len(want) and {r.doc_id for r in held} == {i for i in want if crc32(str(i).encode()) % 5 == 0}
    assert sum(r.lang_pred == want[r.doc_id] for r in held) / len(held) > 0.98
    assert all(0 <= r.score <= 1 for r in got)


def test_language_of_odd_rows(spark):
    model = langid.LanguageModel.of_counts({"a": Counter(word=3)})
    odd = [(1, None), (None, "word"), (2, ""), (3, "9"), (3, "9"), (4, "word " * 50_000)]
    got = [(str(r.doc_id), r.lang_pred) for r in langid.identify(frame(spark, odd), model).collect()]
    assert sorted(got) == [("1", "und"), ("2", "und"), ("3", "und"), ("3", "und"), ("4", "a"), ("None", "a")]
    empty = langid.train(frame(spark, []), lm.F.lit(True))
    assert empty.languages == () and langid.identify(frame(spark, [(1, "a b")]), empty).first().lang_pred == "und"


def test_quality_held_out_accuracy(spark):
    got = {r.doc_id: r for r in quality.query(spark, SF).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert {i for i, r in got.items() if r.held_out} == {i for i in got if crc32(str(i).encode()) % 4 == 2}
    held = [(got[i], y) for i, y in labels.items() if got[i].held_out]
    assert sum(r.predicted == y for r, y in held) / len(held) > 0.93
    assert sum(r.predicted for r, y in held if y) / sum(y for _, y in held) > 0.98
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got.values())


def test_language_numerals_are_no_letters(spark):
    model = langid.LanguageModel.of_counts({"a": Counter(word=3)})
    memo = Memo(model.unseen, 9)
    for text in ("½ ² 12", "① Ⅷ", "_ ٣ ③"):
        assert model.predict(text, memo) == ("und", 0.0)
    assert langid.words_of("Ça x²y 一二 ªº") == ["ça", "x", "y", "一二", "ªº"]
    assert all(langid.words_of(c) == ([c.lower()] if unicodedata.category(c)[0] == "L" else []) for c in map(chr, range(0x3000)) if len(c.lower()) == 1)


def test_language_training_against_plain_counts(spark):
    """The model of a small table against counts by loops; null languages and texts teach nothing, ties go to the first name."""
    rng = random.Random(6)
    data = [(i, " ".join(rng.choice(["alpha", "beta", "gamma²", "été", "x"]) for _ in range(rng.randrange(9))), rng.choice(["en", "fr", None])) for i in range(80)]
    data += [(90, None, "en"), (91, "onlyhere", "zz"), (None, "alpha", "fr"), (3, data[3][1], data[3][2])]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string")
    model = langid.train(docs, lm.F.coalesce(lm.F.col("doc_id") % 5 != 0, lm.F.lit(False)))
    words, grams = {}, {}
    for i, t, lang in data:
        if i is not None and i % 5 and lang and t is not None:
            for w in words_by_category(t.lower()):
                words.setdefault(lang, Counter())[w] += 1
                for n in range(1, 6):
                    for g in ((w if n == 1 else f"^{w}$")[k : k + n] for k in range(len(w) + (0 if n == 1 else 2) - n + 1)):
                        grams.setdefault(lang, Counter())[g] += 1
    every, parts = set().union(*words.values()), set().union(*grams.values())
    assert model.languages == ("en", "fr", "zz") and set(model.words) == every and set(model.grams) == parts
    for k, lang in enumerate(model.languages):
        n = sum(words[lang].values())
        for w, at in model.words.items():
            assert model.word_logs[at, k] == pytest.approx(math.log((words[lang][w] + 0.1) / (n + 0.1 * len(every))))
        for g, at in model.grams.items():
            same = sum(c for x, c in grams[lang].items() if len(x) == len(g))
            assert model.gram_logs[at, k] == pytest.approx(math.log((grams[lang][g] + 0.1) / (same + 1)))
    tied = langid.LanguageModel.of_counts({"b": Counter(w=1), "a": Counter(w=1)})
    assert tied.predict("w", Memo(tied.unseen, 9)) == ("a", 0.5)
    many = langid.train(docs.withColumn("lang", lm.F.concat(lm.F.lit("l"), lm.F.col("doc_id"))), lm.F.lit(True))
    assert len(many.languages) == 81  # without null ids and texts


def words_by_category(text):
    return "".join(c if unicodedata.category(c)[0] == "L" else " " for c in text).split()


def test_quality_gradient_and_scores_agree():
    texts = ["good words here"] * 20 + ["bad** thing** bad**"] * 20 + ["same same same same"] * 20
    labels = [1] * 20 + [0] * 40
    model = quality.fit(texts, labels, epochs=20)
    memo = Memo(model.word, 100)
    good, bad, empty = model.scores(["good words", "bad** bad**", None], memo)
    assert good > 0.9 > 0.1 > bad and empty == pytest.approx(1 / (1 + math.exp(-model.bias)))
    words = "good other other".split()
    rows = [r for w in words for r in quality.features(w)] + [quality.ROWS + int(quality.pair_rows(np.array([quality.word_hash(x) for x in pair], np.uint32))[0]) for pair in zip(words, words[1:])]
    assert model.scores([" ".join(words)], memo)[0] == pytest.approx(1 / (1 + math.exp(-(model.bias + model.odds[rows].mean()))))
    long = model.scores(["good words " * 100_000], memo)[0]
    assert long > 0.9


def test_quality_training_against_plain_descent(monkeypatch):
    """The same descent, feature by feature."""
    monkeypatch.setattr(quality, "ROWS", 64)
    monkeypatch.setattr(quality, "PAIR_ROWS", 128)
    monkeypatch.setattr(quality.features, "__defaults__", (64,))
    texts, labels, width, epochs, rate = ["a bc a", "bc d d", "", "d e a bc"], [1, 0, 1, 0], 3, 4, 0.3
    model = quality.fit(texts, labels, width, epochs, rate, seed=2)
    rng = np.random.default_rng(2)
    vectors = (rng.random((192, width)) - 0.5) / width
    layer, bias, steps = np.zeros((2, width)), np.zeros(2), 0
    for _ in range(epochs):
        for i in rng.permutation(4):
            words = texts[i].split()
            rows = [r for w in words for r in quality.features(w, 64)]
            rows += [64 + int(quality.pair_rows(np.array([quality.word_hash(x) for x in p], np.uint32))[0]) for p in zip(words, words[1:])]
            step, n = rate * (1 - steps / (epochs * 4)), len(rows)
            steps += 1
            mean = sum((vectors[r] for r in rows), np.zeros(width)) / max(1, n)
            e = [math.exp(sum(layer[y][k] * mean[k] for k in range(width)) + bias[y]) for y in (0, 1)]
            gap = [e[y] / sum(e) - (y == labels[i]) for y in (0, 1)]
            back = [sum(gap[y] * layer[y][k] for y in (0, 1)) for k in range(width)]
            for y in (0, 1):
                layer[y] -= step * gap[y] * mean
                bias[y] -= step * gap[y] * 0.1
            for r in rows:
                vectors[r] -= step * np.array(back) / n * min(n, 50)
    np.testing.assert_allclose(model.odds, vectors @ (layer[1] - layer[0]), atol=1e-9)
    assert model.bias == pytest.approx(bias[1] - bias[0])


def test_quality_learns_from_the_rows_it_may(spark, monkeypatch):
    """Null labels and ids, unlabelled and held-out ids teach nothing; an id with two labels gives both; the sample is bounded and the same each time."""
    docs = frame(spark, [*((i, f"text {i}") for i in range(40)), (None, "none"), (7, "text 7"), (8, None), (9, "x" * (quality.SAMPLE_BYTES + 1))])
    rows = [*((i, i % 2) for i in range(30)), (7, 0), (31, None), (None, 1), (32, 5)]
    labels = spark.createDataFrame([(i, y, "x") for i, y in rows], "doc_id long, quality int, text string")
    got = []
    monkeypatch.setattr(quality, "fit", lambda texts, ys: got.append(list(zip(texts, ys))))
    quality.train(docs, labels)
    texts = [(i, t) for i, t in [*((i, f"text {i}") for i in range(40)), (7, "text 7"), (8, "")]]
    want = sorted((t, y) for i, t in texts for j, y in rows if i == j and y in (0, 1) and crc32(str(i).encode()) % 4 != 2)
    assert sorted(got[0]) == want
    for _ in range(2):
        quality.train(docs, labels, sample_texts=10)
    assert got[1] == got[2] and len(got[1]) == 10 and sum(y for _, y in got[1]) == 5 and set(got[1]) <= set(want)
    quality.train(docs, labels.where("quality = 1"))
    assert {y for _, y in got[3]} == {1}


def test_quality_of_odd_rows(spark):
    model = quality.fit([], [])
    got = quality.score(frame(spark, [(1, None), (None, ""), (2, "a b"), (2, "a b")]), model).collect()
    assert sorted((str(r.doc_id), r.score, r.predicted) for r in got) == [("1", 0.5, 0), ("2", 0.5, 0), ("2", 0.5, 0), ("None", 0.5, 0)]
    assert quality.score(frame(spark, []), model).collect() == []


def corpus():
    rng = random.Random(4)
    words = [f"w{i}{c}" for i in range(60) for c in ",.ae"]
    follow = {w: rng.sample(words, 5) for w in words}
    out = []
    for i in range(150):
        w = rng.choice(words)
        text = []
        for _ in range(rng.randrange(60)):
            text.append(w.upper() if rng.random() < 0.1 else w)
            w = rng.choice(follow[w][:2] if rng.random() < 0.5 else words[:40])
        out.append((i, " \n".join(text)))
    return [*out, (None, "w1, new é"), (500, None), (501, ""), (501, ""), (502, "never met"), (503, "w1. " * 3000)]


def plain_tokens(text):
    return [w.lower() if w.isascii() else "".join(c.lower() if c.isascii() else c for c in w) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")] + ["\n"]


def plain_pairs(text):
    words = plain_tokens(text)
    return list(zip([None, *words[:-1]], words))


@pytest.mark.parametrize(("frequent", "frequent_pairs"), [(10_000, 100_000), (20, 30), (0, 0)])
def test_lm_against_its_own_seating(spark, frequent, frequent_pairs):
    """Counts against plain ones, and scores against the formula over the model's tables, whatever goes to the workers."""
    data = corpus()
    learn = [(i, t) for i, t in data if i is not None and i % 3]
    model = lm.train(frame(spark, learn), frequent=frequent)
    assert len(model.places) <= frequent
    numbers = lambda w: lm.START if w is None else model.places.get(w.encode()) or lm.number(w.encode())
    counts, cells = Counter(), Counter()
    for _, t in learn:
        counts.update(plain_tokens(t))
        cells.update(plain_pairs(t))
    words = {r.w: r for r in model.words.collect()}
    contexts = {r.u: r for r in model.contexts.collect()}
    pairs = {(r.u, r.w): r for r in model.pairs.collect()}
    assert {w: r["count"] for w, r in words.items()} == {numbers(w): c for w, c in counts.items()}
    assert {k: r.c for k, r in pairs.items()} == {(numbers(u), numbers(w)): c for (u, w), c in cells.items()}
    sizes = Counter()
    for (u, _), c in cells.items():
        sizes[numbers(u)] += c
    assert {u: r["size"] for u, r in contexts.items()} == dict(sizes)
    assert all(r.own == 0.25 if r.c == 1 else 0.25 <= r.own <= r.c - 0.75 for r in pairs.values())
    n, v = sum(counts.values()), len(counts)

    def probability(u, w):
        u, w = numbers(u), numbers(w)
        own = pairs[u, w].own if (u, w) in pairs else 0.0
        shares = words[w].ps if w in words else model.unseen
        size, backs = (contexts[u]["size"], contexts[u].backs) if u in contexts else (0, [lm.STRENGTH] * len(shares))
        return (own + sum(x * y for x, y in zip(backs, shares)) / len(shares)) / (lm.STRENGTH + size)

    for u in (None, "w1,", "w1. w1.".split()[0], "never"):
        assert sum(probability(u, w) for w in counts) + probability(u, "unheard") == pytest.approx(1)
    got = lm.score(frame(spark, data), model, frequent_pairs=frequent_pairs).collect()
    assert len(got) == len(data)
    want = []
    for i, t in data:
        found = plain_tokens(t)
        base = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in found)
        want.append((str(i), len(found), sum(w in counts for w in found), n, base, sum(math.log10(probability(u, w)) for u, w in plain_pairs(t))))
    have = sorted((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got)
    for x, y in zip(have, sorted(want), strict=True):
        assert x[:4] == y[:4] and x[4:] == pytest.approx(y[4:], rel=1e-9)


class PlainRestaurants:
    """The same model on one machine, customer by customer, with table sizes: [u][w] is a list of them; the parent is [...]."""

    def __init__(self, texts, seed):
        self.rng, self.tables, self.customers, self.served = random.Random(seed), {}, Counter(), Counter()
        self.all = [pair for t in texts for pair in plain_pairs(t)]
        self.words = len({w for _, w in self.all})
        for u, w in self.all:
            self.add(u, w)

    def share(self, u, w):
        if u == "":
            return 1 / (self.words + 1)
        return self.probability("", w)

    def probability(self, u, w):
        at = self.tables.get((u, w), [])
        return (sum(at) - 0.75 * len(at) + (1 + 0.75 * self.served[u]) * self.share(u, w)) / (1 + self.customers[u])

    def add(self, u, w):
        at = self.tables.setdefault((u, w), [])
        weights = [x - 0.75 for x in at] + [(1 + 0.75 * self.served[u]) * self.share(u, w)]
        k = self.rng.choices(range(len(weights)), weights)[0]
        self.customers[u] += 1
        if k < len(at):
            at[k] += 1
        else:
            at.append(1)
            self.served[u] += 1
            if u != "":
                self.add("", w)

    def remove(self, u, w):
        at = self.tables[u, w]
        k = self.rng.choices(range(len(at)), at)[0]
        self.customers[u] -= 1
        at[k] -= 1
        if not at[k]:
            at.pop(k)
            self.served[u] -= 1
            if u != "":
                self.remove("", w)

    def sweep(self):
        for u, w in self.all:
            self.remove(u, w)
            self.add(u, w)


def test_lm_agrees_with_a_plain_sampler(spark):
    """Held-out log10 probability a token against customer-by-customer Gibbs on one machine; both beat the unigram base."""
    data = [(i, t) for i, t in corpus() if i is not None and i < 150]
    learn, held = [t for i, t in data if i % 4], [(i, t) for i, t in data if i % 4 == 0]
    plain, logs = PlainRestaurants(learn, 5), []
    pairs = [p for _, t in held for p in plain_pairs(t)]
    for sweep in range(24):
        plain.sweep()
        if sweep >= 8:
            logs.append([plain.probability(*p) for p in pairs])
    want = float(np.log10(np.mean(logs, axis=0)).mean())
    model = lm.train(frame(spark, list(enumerate(learn))), burn_in=4, kept=8)
    got = lm.score(frame(spark, held), model).collect()
    n = sum(r.n_tokens for r in got)
    assert n == len(pairs) and sum(r.score for r in got) / n == pytest.approx(want, abs=0.01)
    assert want > sum(r.base_score for r in got) / n + 0.05
    served = sum(r.own for r in model.pairs.collect())
    assert served == pytest.approx(sum(sum(t) - 0.75 * len(t) for (u, _), t in plain.tables.items() if u != ""), rel=0.03)


def test_lm_tells_repeated_texts(spark):
    """Texts that training met score above texts of the same words in another order, though their base scores are equal."""
    rng = random.Random(8)
    data = corpus()[:150]
    mixed = []
    for i, t in data:
        words = t.split()
        rng.shuffle(words)
        mixed.append((1000 + i, " ".join(words)))
    got = {r.doc_id: r for r in lm.score(frame(spark, [*data, *mixed]), lm.train(frame(spark, data))).collect()}
    long = [i for i, t in data if len(t.split()) > 10]
    assert all(got[i].base_score == pytest.approx(got[1000 + i].base_score) for i in long)
    assert sum(got[i].score > got[1000 + i].score for i in long) / len(long) > 0.97


def test_lm_joins_pairs_in_parts(spark, monkeypatch):
    """No step of scoring holds the shuffles of all pairs: the result reads finished sums only, and the number of parts does not move it."""
    data = corpus()
    model = lm.train(frame(spark, data[::2]), frequent=20)
    got = {}
    for slices in (1, 4):
        monkeypatch.setattr(lm, "SLICES", slices, raising=False)
        scored = lm.score(frame(spark, data), model, frequent_pairs=30)
        assert not any(x in path for path in scored.inputFiles() for x in ("lm-pairs", "lm-state", "lm-words", "lm-contexts"))
        got[slices] = sorted((str(r.doc_id), r.n_tokens, r.n_known, r.base_score, r.score) for r in scored.collect())
    for x, y in zip(got[1], got[4], strict=True):
        assert x[:3] == y[:3] and x[3:] == pytest.approx(y[3:], rel=1e-9)


def test_lm_gives_memory_back_after_sweeps_and_parts(spark, monkeypatch):
    """The driver's freed memory, which grew with every step, goes back after each of them."""
    times = []
    monkeypatch.setattr(common, "trim", times.append)
    data = corpus()
    model = lm.train(frame(spark, data[::2]), frequent=20)
    trained = len(times)
    assert trained > lm.BURN_IN + lm.KEPT
    lm.score(frame(spark, data), model, frequent_pairs=30)
    assert len(times) - trained > lm.SLICES


def test_lm_sweeps_broadcast_no_tables(spark, monkeypatch):
    """Sweeps have the driver build no hash table of the numbered words, and still find what every context and word has."""
    sweeps, reseat = [], lm._reseat

    def spied(pairs, contexts, words, *rest):
        out = reseat(pairs, contexts, words, *rest)
        tables, customers = ({r[0]: r[1:] for r in x.collect()} for x in (contexts.select("u", "tables"), words.select("w", "n", "r")))
        rows = lm._looked_up(pairs, contexts.select("u", lm.F.col("tables").alias("there")), words.select("w", "n", "r")).collect()
        sweeps.append((out._jdf.queryExecution().executedPlan().toString(), sorted((r.u, r.w) for r in pairs.collect()), rows, tables, customers, getattr(rest[0], "value", None)))
        return out

    monkeypatch.setattr(lm, "_reseat", spied)
    with lm.batches_of(spark, 1000), setting(spark, "spark.sql.autoBroadcastJoinThreshold", -1):
        lm.train(frame(spark, corpus()), burn_in=1, kept=1, frequent=20)
    assert len(sweeps) == 2 and not any("Broadcast" in plan for plan, *_ in sweeps)
    for _, pairs, rows, tables, customers, held in sweeps:
        assert sorted((r.u, r.w) for r in rows) == pairs
        assert {(r.u >= 0, r.w >= 0) for r in rows} == {(x, y) for x in (True, False) for y in (True, False)}
        for r in rows:
            assert (held.tables[r.u] if r.u >= 0 else r.there) == tables[r.u][0]
            assert ((held.customers[r.w], held.roots[r.w]) if r.w >= 0 else (r.n, r.r)) == customers[r.w]


def test_lm_shards_do_not_move_the_result(spark, monkeypatch):
    """Pairs counted and asked for through many shards are those of one shard, and a table that is written keeps no shuffle files."""
    data, got, counted = corpus(), {}, {}
    learn = [(i, t) for i, t in data if i is not None and i % 3]
    model = lm.train(frame(spark, learn), frequent=20)
    for tokens in (4_000_000, 150):
        monkeypatch.setattr(lm, "SHARD_TOKENS", tokens)
        counted[tokens] = sorted(map(tuple, lm.train(frame(spark, learn), frequent=20).pairs.select("u", "w", "c").collect()))
        got[tokens] = sorted((str(r.doc_id), r.n_tokens, r.n_known, r.base_score, r.score) for r in lm.score(frame(spark, data), model).collect())
    assert counted[150] == counted[4_000_000]
    for x, y in zip(got[150], got[4_000_000], strict=True):
        assert x[:3] == y[:3] and x[3:] == pytest.approx(y[3:], rel=1e-9)
    made = spark._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker()
    first = made.shuffleStatuses().size()
    common.cut(spark.range(1000).repartition(3, "id"), "test")
    assert made.shuffleStatuses().size() <= first


@pytest.mark.parametrize("collide", [False, True])
def test_lm_pairs_of_one_hash_stay_apart(monkeypatch, collide):
    rng = np.random.default_rng(2)
    u, w = rng.integers(-40, 40, 5000), rng.integers(-40, 40, 5000)
    if collide:
        monkeypatch.setattr(lm, "digest", lambda u, w: (np.abs(u + w) % 3).astype(np.uint64))
    want = Counter(zip(u.tolist(), w.tolist()))
    x, y, c = lm._summed(u, w, np.ones(5000, np.int64))
    assert dict(zip(zip(x.tolist(), y.tolist()), c.tolist())) == want and len(x) == len(want)
    seek_u, seek_w = np.repeat(np.arange(-45, 45), 90), np.tile(np.arange(-45, 45), 90)
    found = lm._Side(x, y, c[None].astype(float)).find(seek_u, seek_w, np.zeros((1, 8100)))
    assert found[0].tolist() == [want[k] for k in zip(seek_u.tolist(), seek_w.tolist())]
    order, _ = lm._in_order(x, y)
    assert sorted(order.tolist()) == list(range(len(x)))
    some = rng.integers(-(1 << 62), 1 << 62, 100)
    assert (lm._whole(lm._halves(some[:30]), lm._halves(some[30:])) == some).all()


def test_lm_base_columns_equal_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    ids = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", (lm.bucket("doc_id", 10) == 0).alias("held_out")).toPandas()
    con.register("parts", ids)
    want = con.execute(r"""
        WITH t AS (SELECT doc_id, held_out, list_append(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), chr(10)) AS s FROM documents JOIN parts USING (doc_id)),
        e AS (SELECT doc_id, held_out, unnest(s) AS w FROM t), k AS (SELECT w, count(*) AS c FROM e WHERE NOT held_out GROUP BY w), z AS (SELECT sum(c) AS n, count(*) AS v FROM k)
        SELECT doc_id, any_value(held_out), count(*), count(c), any_value(n), sum(log10((coalesce(c, 0) + 0.1) / (n + 0.1 * (v + 1)))) FROM e LEFT JOIN k USING (w), z GROUP BY doc_id ORDER BY doc_id""").fetchall()
    got = lm.query(spark, SF).orderBy("doc_id").collect()
    assert len(got) == len(want)
    for r, x in zip(got, want):
        assert (r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens) == x[:5] and r.base_score == pytest.approx(x[5], rel=1e-9)


def test_seatings_are_counted():
    d = 0.75
    logs = seating.stirling_logs(d, 1200)
    assert np.exp(logs[4, 1:5]) == pytest.approx([(1 - d) * (2 - d) * (3 - d), sum_two(d), 6 * (1 - d), 1.0])
    for c in (257, 600, 1200):
        t = np.arange(1, c + 1)
        assert np.abs(seating.stirling_large(np.full(c, c), t, d) - logs[c, 1 : c + 1]).max() < 0.05
    x = np.array([0.01, 0.5, 3.3, 40.0])
    assert seating.log_gamma(x) == pytest.approx([math.lgamma(v) for v in x], abs=1e-8)


def sum_two(d):
    """Seatings of four customers at two tables: one and three, or two and two."""
    return 4 * (1 - d) * (2 - d) + 3 * (1 - d) ** 2


@pytest.mark.parametrize(("c", "others", "share"), [(2, 3, 0.2), (12, 7, 0.3), (40, 500, 0.05), (300, 40, 0.1), (900, 3000, 0.02)])
def test_tables_follow_their_distribution(c, others, share):
    seater, rng, n = seating.Seater(1.0, 0.75), np.random.default_rng(1), 3000
    logs = seating.stirling_logs(0.75, c)[c, 1:] + np.cumsum(np.log(1 + 0.75 * (others + np.arange(c)))) + np.arange(1, c + 1) * math.log(share)
    p = np.exp(logs - logs.max())
    p /= p.sum()
    mean, sd = float(p @ np.arange(1, c + 1)), float(np.sqrt(p @ np.arange(1, c + 1) ** 2 - (p @ np.arange(1, c + 1)) ** 2))
    t = np.ones(n, np.int64)
    for _ in range(1 if c <= seating.EXACT else 40):
        t = seater.draw(np.full(n, c), t, np.full(n, others), np.full(n, share), rng)
    assert t.mean() == pytest.approx(mean, abs=5 * sd / n**0.5 + 0.02 * sd) and t.std() == pytest.approx(sd, rel=0.1, abs=0.02)
    assert seater.draw(np.array([], np.int64), np.array([], np.int64), np.array([]), np.array([]), rng).tolist() == []


def test_lm_of_nothing(spark):
    model = lm.train(frame(spark, []))
    got = lm.score(frame(spark, [(1, "a b"), (2, None)]), model).collect()
    assert sorted((r.doc_id, r.n_tokens, r.n_known, r.train_tokens) for r in got) == [(1, 3, 0, 0), (2, 1, 0, 0)]
    assert got[0].base_score == pytest.approx(0, abs=1e-9) and lm.score(frame(spark, []), model).collect() == []
