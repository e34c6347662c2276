import hashlib
import random

import xxhash

from quillstack.llm.components import components
from quillstack.llm.exact_dedup import exact_dedup
from quillstack.llm.simhash import fingerprint, simhash_dedup

LONG = "x" * 40_000
ROWS = [
    (1, "a b c", "p"), (2, "a b c", "q"), (3, None, "p"), (4, "", None), (5, "é", "p"), (6, LONG + "1", "p"),
    (7, LONG + "2", "p"), (8, LONG + "1", "p"), (None, "a b c", "p"), (9, "same prefix " * 5 + "a", "p"),
    (9, "same prefix " * 5 + "a", "p"), (10, "same prefix " * 5 + "b", "p"), (None, "lonely", "p"), (11, "A b c", "p"),
]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, kept string")


def test_exact_dedup_against_a_dictionary(spark):
    got = exact_dedup(frame(spark, ROWS)).collect()
    groups = {}
    for i, text, _ in ROWS:
        groups.setdefault(text or "", []).append(i)
    want = sorted(
        (str(i), str(max((x for x in groups[t or ""] if x is not None), default=None)), len(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest())
        for i, t, _ in ROWS
    )
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.text_sha256) for r in got) == want
    assert sum(r.kept for r in got) == len(groups)
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_exact_dedup_of_nothing(spark):
    assert exact_dedup(frame(spark, [])).collect() == []


def brute_fingerprint(text, words=3):
    parts = (text or "").encode().lower().split()
    if not parts:
        return 0
    shingles = [b" ".join(parts[i : i + words]) for i in range(max(1, len(parts) - words + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def test_fingerprint_against_brute_force():
    rng = random.Random(5)
    for n in (0, 1, 2, 3, 4, 50, 999):
        text = " \n".join(rng.choice(["Ab", "b", "É", "d,", "x y"]) for _ in range(n))
        assert fingerprint(text) == brute_fingerprint(text)


def test_simhash_dedup_against_all_pairs(spark):
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(300)]
    rows = [(None, "null id", ""), (90, None, ""), (91, " \t", ""), (92, "one", ""), (92, "one", "")]
    for g in range(12):
        words = [rng.choice(vocabulary) for _ in range(400)]
        for _ in range(12):
            rows.append((100 + len(rows), " ".join(words), ""))
            words[rng.randrange(400)] = rng.choice(vocabulary)
    fps = [brute_fingerprint(t) for _, t, _ in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 3:
                root[find(i)] = find(j)
    smallest = {}
    for i, (d, _, _) in enumerate(rows):
        r = find(i)
        smallest[r] = min((x for x in (smallest.get(r), d) if x is not None), default=None)
    want = sorted((str(d), f"{fps[i]:016x}", str(smallest[find(i)])) for i, (d, _, _) in enumerate(rows))
    got = simhash_dedup(frame(spark, rows)).collect()
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in got) == want
    assert sum(r.kept for r in got) == len({find(i) for i in range(len(rows))})
    assert len({find(i) for i in range(len(rows))}) < len(rows) / 3
    assert simhash_dedup(frame(spark, [])).collect() == []


def test_components_of_a_long_path(spark):
    ids = list(range(60))
    random.Random(1).shuffle(ids)
    edges = spark.createDataFrame([(a, b) for a, b in zip(ids, ids[1:])] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in components(edges).collect()}
    assert got == {**{i: 0 for i in ids}, 100: 100, 101: 100}


def test_texts_of_a_megabyte(spark):
    """Equal and nearly equal texts of over a million characters, beside a hot group of empty ones."""
    rng = random.Random(4)
    words = [f"w{i}" for i in range(5000)]
    long = " ".join(rng.choice(words) for _ in range(200_000))
    data = [(1, long, "p"), (2, long + " end", "p"), (3, long, "p"), (4, long[:-2], "p"), *((10 + i, "", "p") for i in range(300))]
    assert len(long) > 1_000_000
    exact = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup(frame(spark, data)).collect()}
    assert exact[1] == (3, 2, False) and exact[3] == (3, 2, True) and exact[2] == (2, 1, True) and exact[4] == (4, 1, True) and exact[10] == (309, 300, False)
    near = {r.doc_id: (r.component_id, r.kept) for r in simhash_dedup(frame(spark, data)).collect()}
    assert {near[i][0] for i in (1, 2, 3, 4)} == {1} and near[309] == (10, False) and near[10] == (10, True)


def test_hot_groups_beyond_a_broadcast(spark, monkeypatch):
    """The same rows whether a side is broadcast whole or its keys with most rows alone."""
    from quillstack.llm import common

    rng = random.Random(5)
    data = [(i, rng.choice(["hot text of a group", "other", None, f"own {i}", f"pair {i // 2}"]), "p") for i in range(400)]
    want_exact, want_near = (sorted(map(str, f(frame(spark, data)).drop("_f", "_r").collect())) for f in (exact_dedup, simhash_dedup))
    monkeypatch.setattr(common, "BROADCAST_ROWS", 3)
    assert sorted(map(str, exact_dedup(frame(spark, data)).drop("_f", "_r").collect())) == want_exact
    assert sorted(map(str, simhash_dedup(frame(spark, data)).drop("_f", "_r").collect())) == want_near
