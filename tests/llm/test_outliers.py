import random
import re

import numpy as np

from quillstack.llm import outliers as m

BLANK = "\t\n\x0b\f\r "


def brute_base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = {}
    for i in range(len(words) - 4):
        windows.setdefault(tuple(words[i : i + 5]), []).append(i)
    covered = {i + j for at in windows.values() if len(at) > 1 for i in at for j in range(5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if line.strip(BLANK):
            dup += line in seen
            seen.add(line)
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered), n < 10 or 100 * len(covered) > 20 * n


FLOOR = np.array(list(m.FLOORS.values()))


def far(x, mean, cov):
    return np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)


def moments(x):
    return x.mean(axis=0), np.cov(x.T, bias=True).reshape(6, 6) + np.diag(FLOOR**2)


def brute_estimate(x):
    """Mean and covariance of one level's vectors in numpy: three starts, the least determinant, reweighting."""
    rank = lambda v, p: np.sort(v)[max(0, int(np.ceil(p * len(v))) - 1)]
    place = lambda d: np.floor(np.log2(d + 0.001) * m.BINS)

    def step(mean, cov):
        at = place(far(x, mean, cov))
        return moments(x[at <= rank(at, m.SHARE)])

    middle = np.array([rank(v, 0.5) for v in x.T])
    s = np.sqrt(np.array([(1.4826 * rank(abs(v - y), 0.5)) ** 2 for v, y in zip(x.T, middle)]) + FLOOR**2)
    z = (x - middle) / s
    found = []
    for form in (None, np.tanh(z), z / np.maximum(np.linalg.norm(z, axis=1), 1e-9)[:, None]):
        cov = np.diag(s**2)
        if form is not None:
            c = form.T @ form
            scale = np.sqrt(np.outer(np.diag(c), np.diag(c)))
            off = np.divide(0.9 * c, scale, out=np.zeros_like(c), where=scale > 0) * np.outer(s, s)
            cov = np.where(np.eye(6) > 0, cov, off)
        now = (middle, cov)
        for _ in range(m.STEPS):
            now = step(*now)
        found.append(now)
    now = min(found, key=lambda e: np.linalg.det(e[1]))
    for _ in range(m.MORE_STEPS):
        now = step(*now)
    d = far(x, *now)
    limit = max(1.0, 2 ** ((rank(place(d), 0.5) + 1) / m.BINS) / m.MEDIAN) * m.NEAR
    near = x[d <= limit]
    return len(near), *moments(near)


def drawn(own, above):
    n, mean, cov = own
    w, gap = n / (n + m.PRIOR), mean - above[1]
    return n, w * mean + (1 - w) * above[1], w * cov + (1 - w) * above[2] + w * (1 - w) * np.outer(gap, gap)


def brute_distances(x, langs, groups):
    out = np.zeros(len(x))
    top = brute_estimate(x)
    for lang in set(langs):
        of_lang = drawn(brute_estimate(x[[i for i, g in enumerate(langs) if g == lang]]), top)
        for group in {g for g, other in zip(groups, langs) if other == lang}:
            at = [i for i, g in enumerate(groups) if g == group]
            _, mean, cov = drawn(brute_estimate(x[at]), of_lang)
            out[at] = far(x[at], mean, cov)
    return out


def rows():
    rng = random.Random(9)
    words = [f"word{chr(97 + i % 26)}" * (1 + i % 2) for i in range(80)]
    out = []
    for i in range(260):
        text = " ".join(rng.choice(words) for _ in range(rng.randrange(15, 300)))
        if i % 40 == 7:
            text = re.sub(r"(\w) ", r"\1*** ", text)
        out.append((i, text.replace(" worda ", "\n"), "en" if i % 2 else None, "big" if i % 10 else "small", 1))
    odd = [None, "", " \t", "a b c d e f " * 40, "one two three four five six seven eight nine", "x " * 30_000, "Same line here now\n" * 9 + "b\n\nb\n é # é"]
    return out + [(None if i == 1 else 1000 + i, t, None, None, 1) for i, t in enumerate(odd)] + [out[0]]


def frame(spark, data):
    return spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n int")


def test_against_brute_force(spark):
    data = rows()
    got = m.quality_rules(frame(spark, data)).orderBy("_r", "_f").collect()
    assert len(got) == len(data)
    base = sorted([(str(i), *brute_base(t)) for i, t, *_ in data])
    assert sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == base
    text = {i: t for i, t, *_ in data}
    upper = {i: sum(c.isupper() for c in t or "") for i, t, *_ in data}
    place = {i: (lang, source) for i, _, lang, source, _ in data}

    def vector(r):
        n, chars = r.n_words, r.word_chars
        return [np.log1p(n), np.log((chars + 150) / (n + 30)), np.sqrt(r.n_symbols / (chars + 50)), np.log1p(r.n_dup_lines), np.sqrt(r.n_repeat_words / (n + 20)), np.sqrt((upper[r.doc_id] + 2) / (chars + 50))]

    passed = [r for r in got if not r.base_failed]
    want = brute_distances(np.array([vector(r) for r in passed]), [place[r.doc_id][0] for r in passed], [place[r.doc_id] for r in passed])
    np.testing.assert_allclose([r.distance for r in passed], want, rtol=1e-6)
    assert all(r.kept == (not r.base_failed and (r.distance or 0) <= m.FAR) for r in got)
    marked = [r for r in passed if "***" in text[r.doc_id]]
    assert marked and not any(r.kept for r in marked)
    clean = [r for r in passed if "***" not in text[r.doc_id] and r.doc_id < 1000]
    assert all(r.kept for r in clean)


def test_base_columns_equal_sql(spark):
    import duckdb

    con, sf = duckdb.connect(), "/root/testdata/sf0.01"
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = con.execute(r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS s FROM documents),
        w AS (SELECT doc_id, unnest(s) AS word, generate_subscripts(s, 1) AS i FROM d),
        v AS (SELECT doc_id, i, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS five, count(*) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS n FROM w),
        r AS (SELECT doc_id, i FROM v WHERE n = 5 QUALIFY count(*) OVER (PARTITION BY doc_id, five) > 1),
        c AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(generate_series(i, i + 4)) AS j FROM r) GROUP BY doc_id),
        l AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id)
        SELECT doc_id, len(s), len(array_to_string(s, '')), len(regexp_replace(t, '[^#*$%&|<>]', '', 'g')), coalesce(l.n, 0), coalesce(c.n, 0), len(s) < 10 OR 100 * coalesce(c.n, 0) > 20 * len(s)
        FROM d LEFT JOIN c USING (doc_id) LEFT JOIN l USING (doc_id) ORDER BY doc_id""").fetchall()
    got = m.query(spark, sf).orderBy("doc_id").collect()
    assert [(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got] == want


def test_groups_of_every_size(spark):
    """Groups of 1, 5, 60 and 20,000 rows against the plain estimate, without the texts."""
    rng = np.random.default_rng(5)
    sizes = {("en", "hot"): 20_000, ("en", "mid"): 60, ("en", "few"): 5, ("fr", "one"): 1, ("fr", "mid"): 61}
    groups = [g for g, n in sizes.items() for _ in range(n)]
    x = rng.normal([5, 1.6, 0.05, 0.2, 0.1, 0.2], [0.8, 0.1, 0.05, 0.3, 0.1, 0.05], (len(groups), 6)) + np.array([g[0] == "fr" for g in groups])[:, None] * 0.2
    x[::17] += 2
    data = [(i, 0, g[0], "/".join(g), *map(float, v)) for i, (g, v) in enumerate(zip(groups, x))]
    vectors = m.cut(spark.createDataFrame(data, "_f long, _r long, lang string, group string, " + ", ".join(f"{n} double" for n in m.NAMES)), "test-vectors")
    got = {r._f: r.d2 for r in m._robust_distances(vectors).collect()}
    np.testing.assert_allclose([got[i] for i in range(len(x))], brute_distances(x, [g[0] for g in groups], groups), rtol=1e-6)
    far_off = np.array([got[i] > m.FAR for i in range(len(x))])
    assert far_off[::17].mean() > 0.99 and far_off.reshape(-1)[[i for i in range(len(x)) if i % 17]].mean() < 0.03


def test_mild_junk_is_rejected(spark):
    rng = random.Random(3)
    words = [f"word{chr(97 + i % 26)}" * (1 + i % 2) for i in range(80)]
    data = []
    for i in range(300):
        text = [rng.choice(words) for _ in range(rng.randrange(40, 300))]
        if i % 30 == 7:  # every third word is a bar
            text = [w for j, word in enumerate(text) for w in ([word, "|"] if j % 2 else [word])]
        data.append((i, " ".join(text), "en", "big", 1))
    got = {r.doc_id: r for r in m.quality_rules(frame(spark, data)).collect()}
    barred = [r for i, r in got.items() if i % 30 == 7]
    assert any(r.distance <= 43.34 for r in barred) and not any(r.kept for r in barred)
    assert all(r.kept for i, r in got.items() if i % 30 != 7)


def test_of_little(spark):
    assert m.quality_rules(frame(spark, [])).collect() == []
    assert [r.kept for r in m.quality_rules(frame(spark, [(1, None, None, None, 1)])).collect()] == [False]
