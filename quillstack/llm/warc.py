"""WARC archives in Zstandard frames.

An archive is one file: a skippable frame with the dictionary, then one frame for each record. Writers
fill archives of a bounded size in the shared folder and report the paths they completed; a task that
is run again writes other files, and only reported ones are read. The reader loads the dictionary from
the leading frame, finds the frames by their block headers, decodes them one by one and validates
record headers, lengths and digests. It takes other writers' archives as well: frames without their size,
no dictionary, records of other types, digests in base 32 or none.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstack.llm.common import cut, joined, keyed, new_path, table

#: Smallest payload that revisits another; bytes of an archive before the next begins; the dictionary's size and sample.
MIN_REVISIT, ARCHIVE_BYTES, DICT_BYTES, SAMPLE_ROWS, SAMPLE_BYTES = 1000, 8 << 20, 64 << 10, 400, 20_000
LEVEL = 3
# Fixed values of the Zstandard frame format and of its dictionary convention for archives.
FRAME_MAGIC, DICT_FRAME_MAGIC, DICT_MAGIC = 0xFD2FB528, 0x184D2A5D, 0xEC30A437
WARC_DATE = "2024-01-01T00:00:00Z"


def train_dictionary(pages: DataFrame, text_column: str) -> bytes:
    """A dictionary from a bounded sample by hash: about SAMPLE_ROWS rows, twice that at most, SAMPLE_BYTES characters each.

    The sample only sets the compression ratio. Empty where there is too little to learn from.
    """
    held = pages.where(F.col(text_column) != "").select(F.substring(text_column, 1, SAMPLE_BYTES).alias("t"))
    every = held.count() // SAMPLE_ROWS + 1
    rows = held.where(F.pmod(F.xxhash64("t"), F.lit(every)) == 0).limit(2 * SAMPLE_ROWS).collect()
    samples = [r.t.encode() for r in rows]
    if len(samples) < 8:
        return b""
    try:
        return zstandard.train_dictionary(min(DICT_BYTES, sum(map(len, samples)) // 8), samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def dictionary_frame(dictionary: bytes) -> bytes:
    body = zstandard.ZstdCompressor(level=LEVEL).compress(dictionary) if dictionary else b""
    return struct.pack("<II", DICT_FRAME_MAGIC, len(body)) + body


def record_id(page_id: str, url: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {url}')}>"


def record(page_id: str, url: str, payload: bytes, digest: str, refers_to: str | None = None, refers_to_url: str | None = None) -> bytes:
    """The bytes of one record. A revisit has the digest and length of the payload, not the payload."""
    body = payload if refers_to is None else b""
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id, url)}", f"WARC-Date: {WARC_DATE}",
        f"WARC-Target-URI: {url}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}", f"X-Page-ID: {page_id}",
    ]
    if refers_to is not None:
        head += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to, refers_to_url or '')}",
            f"WARC-Refers-To-Target-URI: {refers_to_url or ''}", f"WARC-Refers-To-Date: {WARC_DATE}", f"X-Refers-To-Page-ID: {refers_to}",
        ]
    head += ["Content-Type: text/html", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode("utf-8") + b"\r\n\r\n" + body + b"\r\n\r\n"


def _digest(value: str) -> str | None:
    """A SHA-1 as lower-case hex digits, from those or base 32; None for other digests."""
    kind, _, digits = value.partition(":")
    if kind.strip().lower() != "sha1":
        return None
    digits = digits.strip()
    return digits.lower() if len(digits) == 40 else base64.b32decode(digits.upper()).hex()


def _length(value: str) -> int:
    if not value.isascii() or not value.isdigit():
        raise ValueError(f"a length is no number: {value[:80]!r}")
    return int(value)


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and body; ValueError where the version, a header, a length or a digest is wrong.

    The payload of an HTTP message is what follows its header. A digest is checked if the record has a
    SHA-1 of a payload it holds.
    """
    head, found, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not found or lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise ValueError("not a WARC record")
    fields, name = {}, ""
    for line in lines[1:]:
        if name and line[:1] in (" ", "\t"):  # a value goes on
            fields[name] += " " + line.strip()
            continue
        name, colon, value = line.partition(":")
        name = name.strip().lower()
        if not colon or not name:
            raise ValueError(f"malformed header {line[:80]!r}")
        fields[name] = value.strip(" \t")
    missing = {"warc-type", "warc-record-id", "warc-date", "content-length"} - fields.keys()
    if missing:
        raise ValueError(f"headers are missing: {sorted(missing)}")
    n = _length(fields["content-length"])
    body = rest[:n]
    if len(body) != n or rest[n:] != b"\r\n\r\n":
        raise ValueError("the record is not as long as it says")
    if fields["content-type" if "content-type" in fields else "warc-type"].replace(" ", "").lower().startswith("application/http"):
        body = body.partition(b"\r\n\r\n")[2]
    if fields["warc-type"] != "revisit":
        digest = _digest(fields.get("warc-payload-digest", ""))
        if digest and hashlib.sha1(body).hexdigest() != digest or _length(fields.get("x-payload-length", str(len(body)))) != len(body):
            raise ValueError("the payload differs from its digest or length")
    elif body and "x-payload-length" in fields:
        raise ValueError("a revisit has a body")
    return fields, body


def frame_end(data: bytes, at: int) -> int:
    """The end of the frame that begins at `at`, from its header and block headers."""
    if struct.unpack_from("<I", data, at)[0] != FRAME_MAGIC:
        raise ValueError("not a Zstandard frame")
    flags = data[at + 4]
    single = flags >> 5 & 1
    size_bytes = (single, 2, 4, 8)[flags >> 6]
    at += 5 + (1 - single) + (0, 1, 2, 4)[flags & 3] + size_bytes
    last = False
    while not last:
        if at + 3 > len(data):
            raise ValueError("a frame is cut short")
        block = int.from_bytes(data[at : at + 3], "little")
        last, kind = bool(block & 1), block >> 1 & 3
        if kind == 3:
            raise ValueError("a block of a reserved type")
        at += 3 + (1 if kind == 1 else block >> 3)
    at += 4 * (flags >> 2 & 1)
    if at > len(data):
        raise ValueError("a frame is cut short")
    return at


def read_archive(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records of one archive."""
    raw, at = b"", 0
    if len(data) >= 8 and struct.unpack_from("<I", data, 0)[0] == DICT_FRAME_MAGIC:
        n = struct.unpack_from("<I", data, 4)[0]
        raw, at = data[8 : 8 + n], 8 + n
    if raw and struct.unpack_from("<I", raw, 0)[0] == FRAME_MAGIC:
        raw = zstandard.ZstdDecompressor().decompressobj().decompress(raw)
    if raw and struct.unpack_from("<I", raw, 0)[0] != DICT_MAGIC:
        raise ValueError("the leading frame holds no dictionary")
    decoder = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw)) if raw else zstandard.ZstdDecompressor()
    while at < len(data):
        end = frame_end(data, at)
        yield parse_record(decoder.decompressobj().decompress(data[at:end]))  # also frames that do not tell their size
        at = end


def write_archives(records: DataFrame, dictionary: bytes, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes `records` (page_id, url, payload, digest, refers_to and its url); (path, records, bytes) of each archive, written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        made: list[tuple[str, int, int]] = []
        parts: list[bytes] = []
        coder = None

        def close() -> None:
            name = f"{uuid.uuid4().hex}.warc.zst"
            data = b"".join(parts)
            with store.open_output_stream(f"{root}/{name}", compression=None) as f:
                f.write(data)
            made.append((name, len(parts) - 1, len(data)))
            parts.clear()

        for b in batches:
            for page_id, url, payload, digest, refers_to, refers_to_url in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if coder is None:
                    coder = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
                if not parts:
                    parts.append(dictionary_frame(dictionary))
                    held = len(parts[0])
                parts.append(coder.compress(record(page_id, url, payload, digest, refers_to, refers_to_url)))
                held += len(parts[-1])
                if held >= archive_bytes:
                    close()
        if parts:
            close()
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*made) if made else ([], [], []), (pa.string(), pa.int64(), pa.int64()), strict=True)], names=["path", "records", "bytes"])

    return cut(records.mapInArrow(run, "path string, records long, bytes long"), "warc-files")


def read_archives(files: DataFrame, folder: str | None = None) -> DataFrame:
    """page_id, url, record_type, payload_digest, payload_bytes, refers_to, payload of each record of the archives `files` (path).

    Paths are relative to `folder` if there is one. Archives are read where their paths go, one at a time in
    a task, so none is shuffled. page_id and refers_to are null for records without this writer's headers
    (refers_to is then the record id in WARC-Refers-To), the digest where a record has none, url where it
    names no target.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        names = ["page_id", "url", "record_type", "payload_digest", "payload_bytes", "refers_to", "payload"]
        types = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
        made = lambda rows: pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
        for b in batches:
            for path in b.column(0).to_pylist():
                store, place = fs.FileSystem.from_uri(f"{folder}/{path}" if folder else path)
                with store.open_input_file(place) as f:
                    data = f.read()
                rows, held = [], 0
                for fields, body in read_archive(data):
                    digest = fields.get("warc-payload-digest", "")
                    rows.append((
                        fields.get("x-page-id"), fields.get("warc-target-uri"), fields["warc-type"], (_digest(digest) or digest) or None,
                        _length(fields.get("x-payload-length", str(len(body)))), fields.get("x-refers-to-page-id", fields.get("warc-refers-to")), body,
                    ))
                    held += len(body)
                    if held > 16 << 20:
                        yield made(rows)
                        rows, held = [], 0
                if rows:
                    yield made(rows)

    n = min(max(1, files.count()), 10_000)
    return files.select("path").repartition(n).mapInArrow(
        run, "page_id string, url string, record_type string, payload_digest string, payload_bytes long, refers_to string, payload binary"
    )


def warc_round_trip(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", text_column: str = "html", min_revisit: int = MIN_REVISIT) -> DataFrame:
    """Archives `pages` and reads them back: page_id, url, record_type, payload_digest, payload_bytes, refers_to, payload.

    A null payload counts as empty, a null url as an empty one; line breaks in urls, and a space at an end, are
    written as %0D, %0A and %20. Of equal payloads of at least min_revisit bytes the page with the largest id is the response (a
    null id is below all others and its refers_to null); of repeated rows of that id one is. The payload
    of a revisit is null. Other columns are not read. An empty table gives no rows.
    """
    spark = pages.sparkSession
    url = F.replace(F.replace(F.coalesce(F.col(url_column), F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    url = F.regexp_replace(url, r"^[ \t]|[ \t]$", "%20")
    base = keyed(
        pages, F.col(id_column).cast("long").alias("page_id"),
        url.alias("url"),
        F.coalesce(F.col(text_column), F.lit("")).cast("binary").alias("payload"),
    ).withColumns({"key": F.sha2("payload", 256), "n": F.octet_length("payload")})
    me = F.struct("page_id", "_f", "_r", "url")
    shared = cut(base.where(F.col("n") >= min_revisit).groupBy("key").agg(F.count("*").alias("rows"), F.max(me).alias("top")).where("rows > 1"), "warc-shared")
    is_top = (F.col("top._f") == F.col("_f")) & (F.col("top._r") == F.col("_r"))
    records = joined(base, shared, ["key"], "rows", "left", F.col("top.url")).select(
        F.coalesce(F.col("page_id").cast("string"), F.lit("")).alias("page_id"), "url", "payload", F.sha1("payload").alias("digest"),
        F.when(F.col("top").isNotNull() & ~is_top, F.coalesce(F.col("top.page_id").cast("string"), F.lit(""))).alias("refers_to"), F.col("top.url").alias("refers_to_url"),
    )
    folder = new_path(spark, "warc")
    files = write_archives(records, train_dictionary(pages, text_column), folder)
    if files.limit(1).count() == 0:
        return spark.createDataFrame([], "page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, payload binary")
    back = read_archives(files, folder)
    as_id = lambda c: F.nullif(F.col(c), F.lit("")).cast("long").alias(c)
    return back.select(as_id("page_id"), "url", "record_type", "payload_digest", "payload_bytes", as_id("refers_to"), F.when(F.col("record_type") == "response", F.col("payload")).alias("payload"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
g AS (SELECT page_id, body, strlen(body) AS n, max(page_id) OVER (PARTITION BY body) AS top FROM p)
SELECT page_id, n AS payload_bytes, sha1(body) AS payload_digest,
       CASE WHEN n >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id <> top THEN top END AS refers_to
FROM g
"""
