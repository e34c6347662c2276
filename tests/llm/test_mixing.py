import math

import pytest

from quillstack.llm.mixing import mix


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string, weight string")


def rows():
    out = []
    for source, n in (("big", 900), ("mid", 120), ("small", 30), (None, 25)):
        out += [(len(out) + i, "w " * (5 + i % 9), source, "x") for i in range(n)]
    return out + [(None, "a b", "mid", None), (5000, None, "big", ""), (5001, "", "empty", ""), (1, "again and again", "big", "")]


def reference_weights(tokens, entropy, max_passes, budget):
    total = sum(tokens.values())

    def at(a):
        raised = {s: (t / total) ** a for s, t in tokens.items()}
        z = sum(raised.values())
        w = {s: v / z for s, v in raised.items()}
        return w, -sum(x * math.log(x) for x in w.values()), max(budget * w[s] / t for s, t in tokens.items())

    def bisect(holds):
        low, high = 0.0, 1.0
        if holds(low):
            return low
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (low, mid) if holds(mid) else (mid, high)
        return high

    goal = entropy * math.log(len(tokens))
    a = max(bisect(lambda x: at(x)[1] < goal), bisect(lambda x: at(x)[2] <= max_passes))
    return a, at(a)[0]


@pytest.mark.parametrize(("entropy", "max_passes"), [(0.8, 100.0), (0.95, 4.0), (0.0, 3.0)])
def test_mix_against_a_plain_reference(spark, entropy, max_passes):
    data = rows()
    tokens = {}
    for _, text, source, _ in data:
        tokens[source] = tokens.get(source, 0) + len((text or "").split())
    budget = sum(tokens.values())
    tokens = {s: t for s, t in tokens.items() if t}
    exponent, weights = reference_weights(tokens, entropy, max_passes, budget)
    got = mix(frame(spark, data), entropy=entropy, max_passes=max_passes).collect()
    assert got[0].exponent == pytest.approx(exponent, abs=1e-6)
    assert {r.source for r in got} == set(tokens)
    for source, t in tokens.items():
        mine = [r for r in got if r.source == source]
        assert mine[0].weight == pytest.approx(weights[source], rel=1e-5)
        need = weights[source] * budget
        assert need - 14 <= sum(r.n_tokens for r in mine) <= need + 1e-6 * budget
        copies = {}
        for r in mine:
            copies.setdefault((r._f, r._r), []).append(r["pass"])
        whole = int(need / t + 1e-8)
        assert {len(p) for p in copies.values()} <= {whole, whole + 1}
        assert all(sorted(p) == list(range(len(p))) for p in copies.values())
    again = mix(frame(spark, data), entropy=entropy, max_passes=max_passes).collect()
    assert len(again) == len(got)


def test_mix_of_little(spark):
    assert mix(frame(spark, [])).collect() == []
    assert mix(frame(spark, [(1, None, "a", ""), (2, "", None, "")])).collect() == []
    one = mix(frame(spark, [(1, "a b c", "a", "")])).collect()
    assert [(r.doc_id, r["pass"], r.weight) for r in one] == [(1, 0, 1.0)]


def test_a_copied_table_mixes_alike(spark, tmp_path):
    """The permutation hangs on the rows, not on where they are stored; a text of a million words is one row like any other."""
    data = [*rows(), (6000, "w " * 1_000_000, "big", "")]
    first, second = str(tmp_path / "a"), str(tmp_path / "elsewhere" / "b")
    frame(spark, data).coalesce(1).write.parquet(first)
    spark.read.parquet(first).coalesce(1).write.parquet(second)
    got = [sorted((str(r.doc_id), r.n_tokens, r["pass"], r.block) for r in mix(spark.read.parquet(p), max_passes=3.0).collect()) for p in (first, second)]
    assert got[0] == got[1] and any(x[1] == 1_000_000 for x in got[0])
