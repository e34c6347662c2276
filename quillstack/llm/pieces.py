"""SentencePiece encoding and decoding over a relational lattice.

Texts are cut before runs of space marks (a piece never has a mark after another character) and around
characters that no piece has, and the distinct segments are counted. Their substrings of bounded length are exploded and joined to the piece
table, the edges grouped by segment, and a segment's pieces folded from its edges with `aggregate`: for
unigram models the best path (Viterbi), for BPE models the merges, best rank first. BPE pieces have ranks,
not probabilities, and the path of the best summed rank is another segmentation than their encoder's.

Ids go back to the texts where these are read: the most frequent segments are sent to all workers, and the
others to the texts that have them, as one file in the shared folder for each block of rows. No text moves.

Decoding is the inverse, by batches.
"""

from __future__ import annotations

import heapq
import re
import struct
import uuid
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstack.llm.common import cut, drop_memos, forget, keyed, ladder, new_path, release, setting, table, texts_of, worker_memo, written

MARK = "▁"
MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
#: Segments that every worker holds; rows of a block; segments that a counting task holds before it passes them on.
FREQUENT, BLOCK_BITS, FLUSH = 200_000, 13, 1_000_000
#: Parts of the other segments that go to the blocks one after another.
SLICES = 4
#: Characters of a segment in the lattice of a BPE model (boundaries are bits of a long); longer ones are merged one by one.
#: Segments of a lattice partition, about.
LATTICE_CHARS, LATTICE_ROWS = 60, 20_000
#: The lattice gives a character without a piece the least score less this.
UNKNOWN_PENALTY = 10.0
NEVER = float("inf")


@dataclass(frozen=True)
class PieceModel:
    pieces: tuple[str, ...]
    scores: tuple[float, ...]
    normal: frozenset[int]
    byte_ids: tuple[int, ...]
    unknown: int
    kind: str
    prefix: bool

    @classmethod
    def load(cls, path: str) -> PieceModel:
        """Reads a model file. Only identity normalisation without removal of white space is known."""
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        return cls.of(proto)

    @classmethod
    def of(cls, proto) -> PieceModel:
        rules = proto.normalizer_spec
        if rules.precompiled_charsmap or rules.remove_extra_whitespaces or not rules.escape_whitespaces:
            raise ValueError("only models with identity normalisation are supported")
        kinds = {1: "unigram", 2: "bpe"}
        if proto.trainer_spec.model_type not in kinds:
            raise ValueError("only unigram and BPE models are supported")
        pieces = tuple(p.piece for p in proto.pieces)
        normal = frozenset(i for i, p in enumerate(proto.pieces) if p.type == 1)
        if any(MARK in pieces[i].lstrip(MARK) for i in normal):
            raise ValueError("a piece has a space mark after another character")
        by_type = {t: [i for i, p in enumerate(proto.pieces) if p.type == t] for t in (2, 6)}
        return cls(pieces, tuple(p.score for p in proto.pieces), normal, tuple(by_type[6]), by_type[2][0], kinds[proto.trainer_spec.model_type], rules.add_dummy_prefix)

    def merger(self) -> Callable[[str], tuple[int, ...]]:
        """The encoder of one segment by merges: the pair of the best rank first, of equals the leftmost."""
        ids = {self.pieces[i]: i for i in self.normal}
        rank = {self.pieces[i]: -self.scores[i] for i in self.normal}.get

        def short(parts: list[str]) -> list[str]:
            found = [rank(a + b, NEVER) for a, b in zip(parts, parts[1:])]
            while found and (best := min(found)) is not NEVER:
                at = found.index(best)
                whole = parts[at] + parts[at + 1]
                parts[at : at + 2] = [whole]
                del found[at]
                if at:
                    found[at - 1] = rank(parts[at - 1] + whole, NEVER)
                if at < len(found):
                    found[at] = rank(whole + parts[at + 1], NEVER)
            return parts

        def long(parts: list[str]) -> list[str]:
            n = len(parts)
            after, before = list(range(1, n + 1)), list(range(-1, n - 1))
            queue = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := rank(parts[i] + parts[i + 1])) is not None]
            heapq.heapify(queue)
            while queue:
                _, i, a, b = heapq.heappop(queue)
                j = after[i]
                if parts[i] != a or j >= n or parts[j] != b:
                    continue
                parts[i], parts[j], after[i] = a + b, "", after[j]
                if after[i] < n:
                    before[after[i]] = i
                for k in (before[i], i):
                    if k >= 0 and after[k] < n and (r := rank(parts[k] + parts[after[k]])) is not None:
                        heapq.heappush(queue, (r, k, parts[k], parts[after[k]]))
            return [p for p in parts if p]

        def encode(segment: str) -> tuple[int, ...]:
            parts = (short if len(segment) <= 48 else long)(list(segment))
            try:
                return tuple(map(ids.__getitem__, parts))
            except KeyError:
                return tuple(chain.from_iterable((ids[p],) if p in ids else self.unseen(p) for p in parts))

        return encode

    @cached_property
    def late(self) -> frozenset[str]:
        """Pieces that, alone, do not come about by merges of better ranks than their own before the last."""
        rank, found = {self.pieces[i]: -self.scores[i] for i in self.normal}, set()
        for piece, own in rank.items():
            parts = list(piece)
            while len(parts) > 1:
                ranks = [rank.get(a + b, NEVER) for a, b in zip(parts, parts[1:])]
                at = min(range(len(ranks)), key=ranks.__getitem__)
                if ranks[at] >= own and len(parts) > 2:
                    found.add(piece)
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return frozenset(found)

    def joined(self) -> set[tuple[str, str]]:
        """Neighbours within a piece."""
        return {pair for i in self.normal for pair in zip(self.pieces[i], self.pieces[i][1:])}

    def unseen(self, character: str) -> tuple[int, ...]:
        if self.byte_ids:
            return tuple(self.byte_ids[b] for b in character.encode("utf-8", "replace"))
        return (self.unknown,)

    @cached_property
    def segment(self) -> re.Pattern[str]:
        """Runs of characters that pieces have, with the marks before them; other runs of marks; each other character."""
        known = "".join(map(re.escape, sorted(set(chain.from_iterable(self.pieces[i] for i in self.normal)) - {MARK})))
        return re.compile((f"{MARK}*[{known}]+|" if known else "") + f"{MARK}+|[^{MARK}]", re.DOTALL)

    def segments(self, text: str) -> list[str]:
        return self.segment.findall(self.marked(text))

    @cached_property
    def cuts_lines(self) -> bool:
        """Whether a line feed is a segment of its own."""
        return not any("\n" in self.pieces[i] for i in self.normal)

    def fragments(self, text: str) -> list[str]:
        """Parts of a text whose segments, one after another, are the text's: mostly segments already, some may be empty.

        Where marks stand alone, a segment never passes the next one, so that texts are cut without a look at each character.
        """
        if "  " in text or MARK in text or "\0" in text or self.prefix and text[:1] == " ":
            return self.segments(text)
        marked = MARK * (self.prefix and bool(text)) + text.replace(" ", "\0" + MARK)
        return (marked.replace("\n", "\0\n\0") if self.cuts_lines else marked).split("\0")

    def marked(self, text: str) -> str:
        return MARK * (self.prefix and bool(text)) + text.replace(" ", MARK)

    @cached_property
    def spellings(self) -> tuple[bytes, ...]:
        """The bytes of each piece."""
        as_bytes = {x: bytes((i,)) for i, x in enumerate(self.byte_ids)}
        return tuple(as_bytes.get(i) or x.encode() for i, x in enumerate(self.pieces))

    def spoken(self, spelled: bytes) -> str:
        """The text of the bytes of pieces."""
        text = spelled.decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if self.prefix and text[:1] == " " else text

    def decode(self, ids: Iterator[int]) -> str:
        return self.spoken(b"".join(map(self.spellings.__getitem__, ids)))


def _count_segments(base: DataFrame, model: PieceModel) -> DataFrame:
    """block, segment, c: the segments of each block of rows of `base` (_f, _r, doc_id, text) and their counts, maybe in parts."""
    shared = base.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_memos()
        fragments, segment = shared.value.fragments, shared.value.segment
        held, block = Counter(), None

        def out() -> pa.RecordBatch:
            for x in [x for x in held if not segment.fullmatch(x)]:
                c = held.pop(x)
                for part in segment.findall(x):
                    held[part] += c
            made = pa.RecordBatch.from_arrays([pa.array(np.full(len(held), block, np.int64)), pa.array(held, pa.string()), pa.array(held.values(), pa.int64())], names=["block", "segment", "c"])
            held.clear()
            return made

        for b in batches:
            for now, text in zip(_blocks(b), texts_of(b.column(3)), strict=True):
                if held and (now != block or len(held) >= FLUSH):
                    yield out()
                block = now
                held.update(fragments(text or ""))
        if held:
            yield out()

    return base.mapInArrow(run, "block long, segment string, c long")


def _blocks(b: pa.RecordBatch) -> Iterator[int]:
    """The block of each row of a batch that begins with _f and _r: a hash of the file and the higher bits of the place."""
    for f, r in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
        yield xxhash.xxh64_intdigest(struct.pack("<qq", f, r >> BLOCK_BITS)) >> 1


def _merged(segments: DataFrame, model: PieceModel) -> DataFrame:
    """(segment, c, ids) of `segments` by merges one by one: those too long for the lattice, or with characters that have no piece."""
    shared = segments.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merge = shared.value.merger()
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([list(merge(x)) for x in b.column(0).to_pylist()], pa.list_(pa.int32()))], names=["segment", "c", "ids"])

    return segments.select("segment", "c").mapInArrow(run, "segment string, c long, ids array<int>")


def _with_room(segments: DataFrame, model: PieceModel, longest: int) -> DataFrame:
    """`segments` (segment, c) with room: for each start, how far a piece can reach; null for segments that are
    too long for the lattice or have a character that is no piece.

    No piece spans a place whose neighbours stand beside each other in no piece.
    """
    shared = segments.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        joined_, alone = model.joined(), frozenset(model.pieces[i] for i in model.normal if len(model.pieces[i]) == 1)
        for b in batches:
            rooms: list[list[int] | None] = []
            for x in b.column(0).to_pylist():
                if len(x) > LATTICE_CHARS or not alone.issuperset(x):
                    rooms.append(None)
                    continue
                room, reach = [1] * len(x), 1
                for i in range(len(x) - 2, -1, -1):
                    reach = min(longest, reach + 1) if (x[i], x[i + 1]) in joined_ else 1
                    room[i] = reach
                rooms.append(room)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(rooms, pa.list_(pa.int8()))], names=["segment", "c", "room"])

    return segments.mapInArrow(run, "segment string, c long, room array<tinyint>")


def _digest(part: Column) -> Column:
    return F.xxhash64(part)


def merge_paths(segments: DataFrame, model: PieceModel) -> DataFrame:
    """(segment, c, ids) for distinct `segments` (segment, c): the merges of the best rank first, of equals the leftmost, written.

    Boundaries between characters are bits of a long. A merge is an edge with both ends present, and takes the
    boundary inside away; when none is left, the edges without a boundary inside are the pieces. What happens
    between two boundaries that stay does not hang on what is beyond them, so a piece comes about as it does alone.
    If all its parts have better ranks then, they are merged when its turn comes: one pass over the sorted edges
    does. Segments with a late piece have the best edge looked for after every merge.

    An edge is one long: rank (by place), start, length, whether the piece is late, and id, so that sorted edges are
    in the order of merges. Arrays hold longs only, as every fold is a step of its own whose rows are copied.
    Substrings meet pieces by a digest, a long, and are then compared.
    """
    spark = segments.sparkSession
    ranks = {x: i for i, x in enumerate(sorted({-model.scores[i] for i in model.normal}))}
    rows = [(model.pieces[i], ranks[-model.scores[i]] << 37 | (model.pieces[i] in model.late) << 24 | i) for i in model.normal]
    if len(model.pieces) > 1 << 24:
        raise ValueError("a model has 2 ** 24 pieces at most")
    pieces = spark.createDataFrame(rows, "piece string, code long").select(_digest(F.col("piece")).alias("key"), "piece", "code")  # its size is the model's
    longest = max(len(model.pieces[i]) for i in model.normal)
    roomy, roomy_path = written(_with_room(segments, model, longest), "piece-segments")
    release(spark)
    partitions = roomy.count() // LATTICE_ROWS + 1
    starts = roomy.where("room IS NOT NULL").repartition(partitions, "segment").select("segment", "c", F.posexplode("room").alias("start", "room"))
    parts = starts.selectExpr("segment", "c", "start", "explode(sequence(1, int(room))) AS n").selectExpr("segment", "c", "start", "n", "substring(segment, start + 1, n) AS part").withColumn("key", _digest(F.col("part")))
    # n is 1 at least: a plain inner join would cut each substring twice, to see that none is null, and would be by the strings.
    edges = parts.join(F.broadcast(pieces), "key", "left").where("piece = part OR n < 1").selectExpr("segment", "c", "code | shiftleft(bigint(start), 31) | shiftleft(bigint(n), 25) AS edge")
    grouped = edges.groupBy("segment", "c").agg(F.collect_list("edge").alias("edges"))
    merges = grouped.selectExpr("*", "length(segment) AS size", "exists(edges, e -> (e & 16777216L) <> 0L) AS late", "sort_array(filter(edges, e -> (e & 2113929216L) > 33554432L)) AS merges")
    # In one pass a merge is the bits of its two ends; else those from its first boundary to its last, and the sign says that no merge is left.
    bounds = merges.selectExpr("segment", "c", "edges", """
        if(late,
          aggregate(if(size > 1 AND size(merges) > 0, sequence(2, size), array()), shiftleft(1L, size + 1) - 1L,
            (b, i) -> if(b < 0L, b, aggregate(transform(merges, e -> shiftleft(shiftleft(2L, int(shiftright(e, 25) & 63L)) - 1L, int(shiftright(e, 31) & 63L))), 0L,
              (m, e) -> if(m = 0L AND bit_count(b & e) = 3 AND (b & e & ~shiftleft(e, 1)) <> 0L AND (b & e & ~shiftright(e, 1)) <> 0L, e, m),
              m -> if(m = 0L, b | shiftleft(1L, 63), b & ~(m & shiftleft(m, 1) & shiftright(m, 1))))),
            b -> b & 9223372036854775807L),
          aggregate(transform(merges, e -> shiftleft(shiftleft(1L, int(shiftright(e, 25) & 63L)) + 1L, int(shiftright(e, 31) & 63L))), shiftleft(1L, size + 1) - 1L,
            (b, m) -> if((b & m) = m, b & ~(m - 3L * (m & -m)), b))) AS bounds""")
    # Bounds are named twice, or the optimiser would put their fold into the filter, once for each edge.
    chosen = bounds.selectExpr("segment", "c", """
        sort_array(transform(filter(edges, e -> (shiftright(bounds, int(shiftright(e, 31) & 63L)) & 1L) = 1L
            AND (shiftright(bounds, int(shiftright(e, 31) & 63L) + 1) & (shiftleft(1L, int(shiftright(e, 25) & 63L)) - 1L)) = shiftleft(1L, int(shiftright(e, 25) & 63L) - 1)),
          e -> (shiftright(e, 31) & 63L) * 33554432L + (e & 16777215L))) AS chosen""")
    whole = chosen.selectExpr("segment", "c", "transform(chosen, x -> int(x & 16777215L)) AS ids")
    with setting(spark, "spark.sql.objectHashAggregate.sortBased.fallbackThreshold", 10 * LATTICE_ROWS):  # a partition's segments are few enough for a table
        paths = cut(whole, "piece-paths")
    merged = cut(_merged(roomy.where("room IS NULL"), model), "piece-ids")
    forget(spark, roomy_path)
    release(spark)
    return paths.unionAll(merged)


def best_paths(segments: DataFrame, model: PieceModel) -> DataFrame:
    """(segment, c, ids) for distinct `segments` (segment, c): the path of the largest summed score, written."""
    spark = segments.sparkSession
    rows = [(model.pieces[i], i, float(model.scores[i])) for i in model.normal]
    pieces = spark.createDataFrame(rows, "part string, id int, score double")  # its size is the model's
    longest, worst = max(len(r[0]) for r in rows), min(r[2] for r in rows) - UNKNOWN_PENALTY
    held = cut(segments, "piece-segments")
    partitions = held.count() // LATTICE_ROWS + 1
    starts = held.repartition(partitions, "segment").select("segment", "c", F.explode(F.sequence(F.lit(0), F.length("segment") - 1)).alias("start"))
    lengths = F.sequence(F.lit(1), F.least(F.lit(longest), F.length("segment") - F.col("start")))
    parts = starts.select("segment", "c", "start", F.explode(lengths).alias("n")).select(
        "segment", "c", "start", "n", F.substring("segment", F.col("start") + 1, F.col("n")).alias("part")
    )
    edges = parts.join(F.broadcast(pieces), "part", "left").where("id IS NOT NULL OR n = 1").select(
        "segment", "c", (F.col("start") + F.col("n")).alias("end"), "start", F.coalesce("id", F.lit(model.unknown)).alias("id"),
        F.coalesce("score", F.lit(worst)).alias("score"),
    )
    grouped = edges.groupBy("segment", "c").agg(F.array_sort(F.collect_list(F.struct("end", "start", "id", "score"))).alias("edges"))
    # The state holds the best way to each position; of equal ways the one with the longest last piece.
    folded = grouped.withColumn("ways", F.expr("""
        aggregate(sequence(1, length(segment)), array(named_struct('score', 0D, 'back', 1, 'id', -1)),
          (ways, at) -> concat(ways, array(array_max(transform(filter(edges, e -> e.end = at),
            e -> named_struct('score', ways[e.start].score + e.score, 'back', -e.start, 'id', e.id))))))"""))
    paths = folded.select("segment", "c", F.expr("""
        aggregate(sequence(1, length(segment)), named_struct('at', length(segment), 'ids', cast(array() as array<int>)),
          (s, i) -> if(s.at = 0, s, named_struct('at', -ways[s.at].back, 'ids', concat(array(ways[s.at].id), s.ids))),
          s -> s.ids)""").alias("ids"))
    with setting(spark, "spark.sql.objectHashAggregate.sortBased.fallbackThreshold", 10 * LATTICE_ROWS):
        return cut(paths, "piece-ids")


def _frequent(coded: DataFrame, most: int) -> tuple[pa.Table, int]:
    """Segment and ids of at most `most` of the most frequent segments, and the least count of those."""
    least = ladder(coded, "c", most)
    return coded.where(F.col("c") >= least).select("segment", "ids").toArrow(), least


def _coded(segments: pa.ChunkedArray, ids: pa.ChunkedArray) -> Iterator[tuple[str, bytes]]:
    """Segments, and their ids as the bytes of 32-bit integers."""
    for names, lists in zip(segments.chunks, ids.chunks, strict=True):
        flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int32).tobytes()
        ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False)) * 4
        for name, a, b in zip(names.to_pylist(), [0, *ends[:-1].tolist()], ends.tolist()):
            yield name, flat[a:b]


def _spelled(pieces: pa.LargeBinaryArray, offsets: np.ndarray) -> Iterator[bytes]:
    """The bytes of the pieces of each text; they lie one after another in the array's buffer."""
    if not len(pieces):
        yield from [b""] * (len(offsets) - 1)
        return
    _, places, data = pieces.buffers()
    at = np.frombuffer(places, np.int64)[pieces.offset + offsets].tolist()
    held = memoryview(data) if data else b""
    for a, b in zip(at, at[1:]):
        yield bytes(held[a:b])


class _Known(dict):
    """Ids of the frequent segments and of a block's others; of a fragment those of its segments."""

    findall: Callable[[str], list[str]]

    def __missing__(self, fragment: str) -> bytes:
        parts = self.findall(fragment)
        if parts == [fragment]:
            raise KeyError(fragment)
        return b"".join(map(self.__getitem__, parts))


def _assembled(base: DataFrame, model: PieceModel, coded: DataFrame, counted: DataFrame, counted_path: str) -> DataFrame:
    """The result for `base`, from the ids of all segments and the segments of each block, which are not read again."""
    spark = base.sparkSession
    frequent, least = _frequent(coded, FREQUENT)
    folder = new_path(spark, "piece-blocks")
    partitions = coded.count() // (SLICES * LATTICE_ROWS) + 1  # a partition's segments are few enough for a table
    # Each is dealt once, by segment; then by block. A part of the segments after another, so that the shuffles of one are deleted before the next.
    for part in range(SLICES):
        here = F.pmod(F.xxhash64("segment"), F.lit(SLICES)) == part
        often = F.broadcast(coded.where(here & (F.col("c") >= least)).select("segment"))  # FREQUENT rows at most
        others = coded.where(here & (F.col("c") < least)).select("segment", "ids").repartition(partitions, "segment").hint("shuffle_hash")
        asked = counted.where(here).select("block", "segment").join(often, "segment", "left_anti").repartition(partitions, "segment")
        rare = asked.join(others, "segment").select("block", "segment", "ids")
        rare.repartition("block").write.mode("append").option("compression", "zstd").partitionBy("block").parquet(folder)
        release(spark)
    forget(spark, counted_path)
    release(spark)
    shared, key = spark.sparkContext.broadcast((model, frequent)), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyarrow import parquet as pq

        store, root = fs.FileSystem.from_uri(folder)
        model, frequent = shared.value
        often, known, block = worker_memo(key, lambda: dict(_coded(frequent.column("segment"), frequent.column("ids")))), _Known(), None
        unigram = model.kind == "unigram"
        spelled = pa.array(model.spellings, pa.large_binary())

        def read(block: int) -> _Known:
            place, found = f"{root}/block={block}", _Known(often)
            found.findall = model.segment.findall
            if store.get_file_info(place).type != fs.FileType.NotFound:
                for f in store.get_file_info(fs.FileSelector(place)):
                    if f.path.endswith(".parquet"):
                        with store.open_input_file(f.path) as held:
                            got = pq.ParquetFile(held).read(columns=["segment", "ids"])
                        found.update(_coded(got.column("segment"), got.column("ids")))
            return found

        for b in batches:
            values, lengths, texts = [], [], []
            for now, text in zip(_blocks(b), texts_of(b.column(3)), strict=True):
                if now != block:
                    known.clear()
                    known, block = read(now), now
                text = text or ""
                flat = b"".join(map(known.__getitem__, model.fragments(text)))
                if unigram:  # a run of unknown characters is one unknown piece
                    ids = np.frombuffer(flat, np.int32)
                    ids = ids[(ids != model.unknown) | (np.concatenate(([-1], ids[:-1])) != model.unknown)]
                    flat = ids.tobytes()
                values.append(flat)
                lengths.append(len(flat) // 4)
                texts.append(text)
            offsets = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
            flat = pa.Array.from_buffers(pa.int32(), int(offsets[-1]), [None, pa.py_buffer(b"".join(values))])
            # What the ids spell, text by text.
            same = [model.spoken(x) == text for x, text in zip(_spelled(spelled.take(flat), offsets), texts, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), b.column(2), pa.array(lengths, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), flat), pa.array(same, pa.bool_())],
                names=["_f", "_r", "doc_id", "n_pieces", "ids", "round_trip"],
            )
        known.clear()

    return base.mapInArrow(run, "_f long, _r long, doc_id long, n_pieces long, ids array<int>, round_trip boolean")


def encode(docs: DataFrame, model: PieceModel, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of `docs`: _f, _r (row key), doc_id, n_pieces, ids, round_trip.

    round_trip: whether decoding the ids gives the text back (a text that has space marks of its own, or
    unknown characters, does not). Null and empty texts have no pieces. Repeated rows are encoded alike;
    other columns are not read; an empty table gives no rows.
    """
    base = keyed(docs, F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    counted, counted_path = written(_count_segments(base, model), "piece-counts")
    release(base.sparkSession)
    segments = counted.groupBy("segment").agg(F.sum("c").alias("c"))
    coded = merge_paths(segments, model) if model.kind == "bpe" else best_paths(segments, model)
    release(base.sparkSession)
    return _assembled(base, model, coded, counted, counted_path)


def decode(coded: DataFrame, model: PieceModel) -> DataFrame:
    """`coded` (doc_id, ids and more) with text for ids; null ids give a null text."""
    shared = coded.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [None if x is None else shared.value.decode(x) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return coded.select(F.col("doc_id").cast("long"), "ids").mapInArrow(run, "doc_id long, text string")


def query(spark: SparkSession, sf_dir: str, model_path: str = MODEL_PATH) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), PieceModel.load(model_path)).drop("_f", "_r")
