import random

import numpy as np
import pytest

from quillstack.llm import line_dedup as m

BLANK = "\t\n\x0b\f\r "


def brute(rows, min_chars=20, min_docs=3):
    def key(line):
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(BLANK))

    holders = {}
    for n, (i, text) in enumerate(rows):
        for k in {key(x) for x in (text or "").split("\n")}:
            if len(k) >= min_chars:
                holders.setdefault(k, []).append(i)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        keep = []
        for x in lines:
            ids = holders.get(key(x), [])
            top = max((j for j in ids if j is not None), default=None)
            if not (len(ids) >= min_docs and top is not None and (i is None or i < top)):
                keep.append(x)
        out.append((str(i), len(lines), len(lines) - len(keep), "\n".join(keep)))
    return sorted(out)


def rows():
    rng = random.Random(2)
    shared = [f"A shared line of some length, number {i} é" for i in range(30)] + ["é" * 20, "é" * 19, "exactly twenty chars"]
    out = [(None, shared[0]), (None, None), (900, ""), (901, "\n\n"), (902, shared[1] + "\n" + shared[1].upper() + "\n \t" + shared[1] + "\r"), (902, shared[1])]
    for i in range(80):
        lines = [rng.choice(shared) if rng.random() < 0.4 else f"own {i} {j} and more words here" for j in range(rng.randrange(9))]
        out.append((i, "\n".join(lines)))
    return [*out, (950, "\n".join(f"unique line of a long text {j}" for j in range(5000)) + "\n" + shared[2])]


def frame(spark, data):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in data], "doc_id long, text string, at string, h1 int")


@pytest.mark.parametrize(("shard_keys", "askers", "in_place"), [(1 << 16, 200_000, 64 << 20), (5, 4, 64 << 20), (1 << 16, 200_000, -1), (5, 4, -1)])
def test_against_brute_force(spark, monkeypatch, shard_keys, askers, in_place):
    monkeypatch.setattr(m, "SHARD_KEYS", shard_keys)
    monkeypatch.setattr(m, "ASKERS", askers)
    monkeypatch.setattr(m, "IN_PLACE_BYTES", in_place)
    got = sorted((str(r.doc_id), r.n_lines, r.n_dropped, r.kept_text) for r in m.line_dedup(frame(spark, rows())).collect())
    want = brute(rows())
    assert got == want
    assert any(x[2] for x in want)


def test_keys_that_share_half_a_hash(spark, monkeypatch):
    real = m.line_hashes
    monkeypatch.setattr(m, "IN_PLACE_BYTES", -1)
    monkeypatch.setattr(m, "line_hashes", lambda *x: real(*x).withColumn("h1", m.F.pmod("h2", m.F.lit(7))))
    got = sorted((str(r.doc_id), r.n_lines, r.n_dropped, r.kept_text) for r in m.line_dedup(frame(spark, rows())).collect())
    assert got == brute(rows())


def test_a_text_of_a_million_lines(spark):
    line = "one line that three documents hold, number {}"
    text = "\n".join(line.format(i % 250_000) for i in range(1_000_000))
    got = {r.doc_id: r for r in m.line_dedup(frame(spark, [(i, text) for i in range(3)])).collect()}
    assert [(got[i].n_lines, got[i].n_dropped) for i in range(3)] == [(1_000_000, 1_000_000)] * 2 + [(1_000_000, 0)] and got[0].kept_text == "" and got[2].kept_text == text


def test_shards_against_a_dict():
    rng = np.random.default_rng(3)
    h1, h2 = rng.integers(-(2**63), 2**63, 3000), rng.integers(-(2**63), 2**63, 3000)
    h1[:40] = h1[40:80]
    counts, tops = rng.integers(1, 400, 3000), rng.integers(-(2**62), 2**62, 3000)
    tops[::9] = m.NO_ID
    shard = m.Shard.build(h1, h2, counts, tops)
    again = m.Shard.of_row(shard.row())
    assert len(shard.twins) == 80 and shard.counts.dtype == np.uint16
    ids = rng.integers(-(2**62), 2**62, 3000)
    ids[::5] = m.NO_ID
    want = (counts >= 200) & (tops != m.NO_ID) & (ids < tops)
    for x in (shard, again):
        assert (x.gone(h1, h2, ids, 200) == want).all()
        assert not x.gone(h1, h2 ^ (1 << 40), ids, 1).any()


def test_of_nothing(spark):
    assert m.line_dedup(frame(spark, [])).collect() == []


def test_perfect_hash_is_minimal():
    for n in (0, 1, 2, 1000, 30_000):
        keys = np.random.default_rng(n).integers(0, 2**63, n).astype(np.uint64)
        made = m.PerfectHash.build(keys)
        again = m.PerfectHash(made.packed, made.sizes)
        assert sorted(made.index(keys).tolist()) == list(range(len(np.unique(keys))))
        assert (again.index(keys) == made.index(keys)).all()
        assert made.index(np.arange(50, dtype=np.uint64)).max(initial=-1) < max(n, 1)
