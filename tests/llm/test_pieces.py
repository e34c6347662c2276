import itertools
import random
from pathlib import Path

import pytest

from quillstack.llm.pieces import MODEL_PATH, PieceModel, best_paths, decode, encode

TEXTS = [
    "Hello  world", " lead", "trail ", "a\nb\tc\n\n d", "", "日本 é", "  ", "ﬁ <s> <0x0A> </s>", "x" * 300, "the" * 400, "Thnt eringing onheed, with",
    "ÉÈÀ ñandú 🙂🙂", "a" * 49 + " " * 40 + "b", "\r\n \x00  ",
]


def test_merges_equal_the_library(spark):
    sp = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=MODEL_PATH)
    model = PieceModel.load(MODEL_PATH)
    rng = random.Random(3)
    texts = TEXTS + ["".join(rng.choice("aeinorst  \n,É.") for _ in range(rng.randrange(300))) for _ in range(60)]
    rows = [(i, t, "extra") for i, t in enumerate(texts)] + [(None, None, None), (0, texts[0], "again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = encode(docs, model).collect()
    assert len(got) == len(rows)
    for r in got:
        text = "" if r.doc_id is None else texts[r.doc_id]
        assert r.ids == sp.encode(text) and r.n_pieces == len(r.ids)
        assert model.decode(r.ids) == sp.decode(r.ids) == text and r.round_trip
    assert {r.doc_id: r.text for r in decode(encode(docs.where("doc_id > 0"), model), model).collect()} == dict(list(enumerate(texts))[1:])
    marked = encode(spark.createDataFrame([(1, "x▁y")], "doc_id long, text string"), model).first()
    assert not marked.round_trip and marked.ids == sp.encode("x▁y")
    assert encode(docs.limit(0), model).collect() == []


def test_long_texts_equal_the_library(spark, monkeypatch):
    """Over a million characters, with runs that no piece boundary cuts; and few frequent segments, so that most come from the blocks' files."""
    sp = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=MODEL_PATH)
    from quillstack.llm import pieces

    monkeypatch.setattr(pieces, "FREQUENT", 5)
    monkeypatch.setattr(pieces, "BLOCK_BITS", 1)
    rng = random.Random(9)
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(1, 14))) for _ in range(4000)]
    texts = [" ".join(rng.choice(words) for _ in range(170_000)), "the" * 60_000, *(" ".join(rng.choice(words) for _ in range(20)) for _ in range(30))]
    assert len(texts[0]) > 1_000_000
    got = {r.doc_id: r for r in encode(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), PieceModel.load(MODEL_PATH)).collect()}
    assert all(got[i].ids == sp.encode(t) and got[i].round_trip for i, t in enumerate(texts))


def test_fragments_have_the_segments_of_the_text():
    """Texts are cut at marks and line feeds without the pattern; what is no segment yet is cut by it, to the same segments."""
    model, rng = PieceModel.load(MODEL_PATH), random.Random(4)
    texts = TEXTS + ["".join(rng.choice("ab cd,\n" if i % 2 else "abc  \n\r\0é▁日🙂.x") for _ in range(rng.randrange(14))) for i in range(4000)]
    for text in texts:
        cut = [[x] if model.segment.fullmatch(x) else model.segment.findall(x) for x in model.fragments(text)]
        assert list(itertools.chain.from_iterable(cut)) == model.segments(text)


def test_rare_segments_go_to_the_blocks_in_parts(spark, monkeypatch):
    """Each part is written before the next, so that no step holds the shuffles of all segments; every one arrives."""
    from quillstack.llm import pieces

    monkeypatch.setattr(pieces, "FREQUENT", 5)
    monkeypatch.setattr(pieces, "SLICES", 3, raising=False)
    done = []
    monkeypatch.setattr(pieces, "release", lambda spark: done.append(1))
    model = PieceModel.load(MODEL_PATH)
    texts = [f"word{i} of\nw{i * 7}x, é{i}" for i in range(50)]
    got = encode(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()
    assert len(done) == 5 + pieces.SLICES and len(got) == 50
    for r in got:
        merge = model.merger()
        assert r.ids == list(itertools.chain.from_iterable(map(merge, model.segments(texts[r.doc_id])))) and r.round_trip


def unigram(pieces):
    pb = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")
    proto = pb.ModelProto()
    for piece, score, kind in [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + [(p, s, 1) for p, s in pieces]:
        proto.pieces.add(piece=piece, score=score, type=kind)
    proto.trainer_spec.model_type = 1
    proto.normalizer_spec.name = "identity"
    proto.normalizer_spec.remove_extra_whitespaces = False
    return proto


def test_lattice_equals_the_library_and_all_segmentations(spark):
    sentencepiece = pytest.importorskip("sentencepiece")
    rng = random.Random(11)
    parts = sorted({"".join(rng.choice("abc▁") for _ in range(rng.randrange(1, 5))) for _ in range(90)})
    parts = [p for p in parts if "▁" not in p.lstrip("▁")] + ["a", "b", "▁"]
    proto = unigram([(p, -rng.random() * 9 - 1) for p in dict.fromkeys(parts)])
    model, sp = PieceModel.of(proto), sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
    texts = ["".join(rng.choice("aabbc dé") for _ in range(rng.randrange(14))) for _ in range(80)] + ["ab " * 60, "", " "]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(None, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in encode(docs, model).collect()}
    assert len(got) == len(texts) + 1 and got[None].ids == []
    for i, t in enumerate(texts):
        assert got[i].ids == sp.encode(t), t
        if "é" not in t and "d" not in t and "c" not in t:
            assert model.decode(got[i].ids) == t
    marked = encode(spark.createDataFrame([(1, "a▁b"), (2, "a b")], "doc_id long, text string"), model)
    assert {r.doc_id: r.round_trip for r in marked.collect()} == {1: False, 2: True}
    score = {p.piece: p.score for p in proto.pieces if p.type == 1}
    ids = {p.piece: i for i, p in enumerate(proto.pieces)}
    words = ["▁abba", "ababab", "▁bbaab"]
    paths = {r.segment: r.ids for r in best_paths(spark.createDataFrame([(w, 1) for w in words], "segment string, c long"), model).collect()}
    for w in words:
        ways = []
        for cuts in itertools.product([0, 1], repeat=len(w) - 1):
            at = [0, *[i + 1 for i, c in enumerate(cuts) if c], len(w)]
            split = [w[a:b] for a, b in zip(at, at[1:])]
            if all(p in score for p in split):
                ways.append((sum(score[p] for p in split), [ids[p] for p in split]))
        assert paths[w] == max(ways)[1]


def merges_model(rng):
    """A BPE model of random pieces: some tie, some come about late or never."""
    parts = {"".join(rng.choice("aab") for _ in range(rng.randrange(2, 6))) for _ in range(14)}
    proto = unigram([(x, -float(rng.randrange(20))) for x in sorted(parts)] + [(x, -99.0) for x in "ab▁"])
    proto.trainer_spec.model_type = 2
    return proto


def test_one_pass_and_late_pieces_equal_the_library(spark):
    """Segments without late pieces take one pass over their merges; those with one are looked at again after each merge."""
    sentencepiece = pytest.importorskip("sentencepiece")
    from quillstack.llm import pieces

    given = PieceModel.load(MODEL_PATH)
    assert given.late and all(set(x) == {"▁"} for x in given.late)
    words = ["".join(x) for n in range(1, 8) for x in itertools.product("ab", repeat=n)]
    late, plain = 0, 0
    for seed in range(4):
        proto = merges_model(random.Random(seed))
        model, sp = PieceModel.of(proto), sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
        merge = model.merger()
        with_late = [any(x in w for x in model.late) for w in words]
        late, plain = late + sum(with_late), plain + len(words) - sum(with_late)
        found = {r.segment: r.ids for r in pieces.merge_paths(spark.createDataFrame([("▁" + w, 1) for w in words], "segment string, c long"), model).collect()}
        assert len(found) == len(words)
        for w in words:
            assert found["▁" + w] == list(merge("▁" + w)) == sp.encode(w), (seed, w)
    assert late > 50 and plain > 50


def test_substrings_meet_pieces_by_longs_and_are_compared(spark, monkeypatch):
    """The lattice's join is by a digest, not by strings; digests that are equal confuse no pieces."""
    from quillstack.llm import pieces

    model, words, plans = PieceModel.load(MODEL_PATH), ["▁the", "▁lattice", "of", "▁words,"], []
    real, rows = pieces.cut, spark.createDataFrame([(w, 1) for w in words], "segment string, c long")
    monkeypatch.setattr(pieces, "cut", lambda df, label: plans.append(df._jdf.queryExecution().executedPlan().toString()) or real(df, label))
    merge = model.merger()
    for digest in (pieces._digest, lambda part: (pieces.F.length(part) % 2).cast("long")):
        monkeypatch.setattr(pieces, "_digest", digest)
        assert {r.segment: r.ids for r in pieces.merge_paths(rows, model).collect()} == {w: list(merge(w)) for w in words}
    assert "BroadcastHashJoin [key#" in plans[0] and "BroadcastHashJoin [part#" not in plans[0]


def test_other_models_are_refused():
    proto = unigram([("a", -1.0)])
    proto.trainer_spec.model_type = 3
    with pytest.raises(ValueError):
        PieceModel.of(proto)
    assert Path(MODEL_PATH).exists()
