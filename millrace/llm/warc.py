"""WARC archives with a two-level capture index.

Records are gzip members, packed into segments of an archive. An archive is a
Parquet table of segments (archive, segment, start, data), so that any store
Spark can write holds it and a lost task leaves no half-written file; the
segments' data in order is a plain .warc.gz file.

The index has two levels. Capture lines, sorted by reversed-host URL key, are
cut into compressed blocks. The sparse directory keeps the first key of every
block; blocks grow with the index so that the directory stays below
`MAX_BLOCKS` entries, small enough to send to every task. A lookup searches the
directory by bisection, opens one block, searches that by bisection too, and
reads a byte range of a segment. A revisit has no payload of its own: the record
that it refers to is looked up in the same way, and its bytes give the length
and the digest, which must be those that the revisit states.
"""

from __future__ import annotations

import bisect
import hashlib
import re
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import table, written

MIN_REVISIT = 100
SEGMENT_BYTES = 64 << 10
BLOCK_LINES = 3000
MAX_BLOCKS = 20_000
SALTS = 16
#: Lookups of a block that one task holds at once.
LOOKUPS = 20_000
DATE = "2024-01-01T00:00:00Z"


def url_key(url: str | None) -> str:
    """Reversed host, then path and query: com,example,www)/a?b. Null gives ')/'."""
    parts = urlsplit(url or "")
    host = re.sub(r"[:\s].*", "", (parts.netloc or "").rpartition("@")[2]).lower()
    host = ",".join(reversed(host.split("."))) if host else ""
    query = f"?{parts.query}" if parts.query else ""
    return f"{host}){parts.path or '/'}{query}".replace("\t", "%09").replace("\n", "%0A")


def _safe_key(url) -> str:
    try:
        return url_key(url)
    except ValueError:  # a host that no parser accepts, as "http://[x"
        return ")/" + re.sub(r"\s", "", str(url))


def with_revisits(pages: DataFrame, *, page_id: str = "page_id", html: str = "html", url: str = "url") -> DataFrame:
    """(page_id, url, body, digest, size, refers_to, refers_url) of every row.

    Of equal payloads of at least MIN_REVISIT bytes the smallest page_id stays
    a response, as do rows that repeat that id; refers_to is null for
    responses. Null html is an empty payload; a null id is never referred to; a
    null URL is an empty one. Very long pages stay whole, other columns are not
    looked at, and an empty table gives no rows.

    The table of repeated payloads is salted: a payload that a third of all
    pages share is met in SALTS places.
    """
    body = F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8")
    base = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), body.alias("body"))
    base = base.select("*", F.sha2("body", 256).alias("digest"), F.octet_length("body").cast("long").alias("size"))
    firsts = base.where(F.col("size") >= MIN_REVISIT).groupBy("digest").agg(F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 and first is not null")
    firsts = written(firsts.select("digest", F.col("first.page_id").alias("first_id"), F.col("first.url").alias("first_url"))).select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = base.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int"))
    joined = salted.join(firsts, ["digest", "salt"], "left")
    again = (F.col("page_id") != F.col("first_id")) | F.col("page_id").isNull()
    return joined.select("page_id", "url", "body", "digest", "size", F.when(again, F.col("first_id")).alias("refers_to"), F.when(again, F.col("first_url")).alias("refers_url"))


def _header_text(value) -> str:
    return re.sub(r"[\r\n]", "", value or "")


def _id_text(value: str | None) -> str:
    """An id as it stands in records and capture lines: no blanks or control characters, '' for null."""
    return "" if value is None else quote(value, safe="") or "%"


def _id_of(text: str) -> str | None:
    return {"": None, "%": ""}.get(text, unquote(text))


def _record(page_id: str | None, url: str | None, body: bytes, digest: str, refers: str | None, refers_url: str | None) -> bytes:
    revisit = refers is not None
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{_id_text(page_id)}>",
        f"WARC-Target-URI: {_header_text(url)}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Payload-Length: {len(body)}",
    ]
    if revisit:
        head += [f"WARC-Refers-To: <urn:page:{_id_text(refers)}>", f"WARC-Refers-To-Target-URI: {_header_text(refers_url)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    block = http + (b"" if revisit else body)
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-case names) and payload of one uncompressed record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    block = rest[: int(fields["content-length"])]
    return fields, block.partition(b"\r\n\r\n")[2]


def gzip_member(data: bytes) -> bytes:
    z = zlib.compressobj(4, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def gunzip_member(data: bytes) -> bytes:
    return zlib.decompress(data, 31)


def write_archive(pages: DataFrame) -> DataFrame:
    """Segments of pages, rows as from with_revisits(), one archive per partition.

    (archive, segment, start, data, lines): lines holds the capture line of
    every record, "key<TAB>id<TAB>archive<TAB>segment<TAB>offset<TAB>length".
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        archive, segment, start = TaskContext.get().partitionId(), 0, 0
        held, lines, size = [], [], 0

        def flush():
            return _batch([archive], [segment], [start], [b"".join(held)], ["\n".join(lines)])

        for batch in batches:
            for page_id, url, body, digest, refers, refers_url in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                member = gzip_member(_record(page_id, url, body, digest, refers, refers_url))
                if held and size + len(member) > SEGMENT_BYTES:
                    yield flush()
                    start, segment = start + size, segment + 1
                    held, lines, size = [], [], 0
                lines.append(f"{_safe_key(url)}\t{_id_text(page_id)}\t{archive}\t{segment}\t{size}\t{len(member)}")
                held.append(member)
                size += len(member)
        if held:
            yield flush()

    def _batch(*columns):
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["archive", "segment", "start", "data", "lines"])

    # Ids of any type go as text: no type of a batch can change them.
    rows = pages.select(F.col("page_id").cast("string"), "url", "body", "digest", F.col("refers_to").cast("string"), "refers_url")
    return written(rows.mapInArrow(pack, "archive int, segment int, start long, data binary, lines string"))


def build_index(archive: DataFrame) -> DataFrame:
    """Blocks (first_key, last_key, n_lines, block) of the sorted capture lines.

    The sort key is the URL key, then id and place, so that captures of one
    URL spread over ranges too.
    """
    lines = written(archive.select(F.explode(F.split("lines", "\n")).alias("line")))
    total = lines.count()
    per_block = max(BLOCK_LINES, -(-total // MAX_BLOCKS))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def block(part):
            return pa.RecordBatch.from_arrays([pa.array([part[0]]), pa.array([part[-1]]), pa.array([len(part)], pa.int32()), pa.array([zlib.compress("\n".join(part).encode(), 6)])], names=["first_key", "last_key", "n_lines", "block"])

        held: list[str] = []
        for batch in batches:
            held += batch.column(0).to_pylist()
            while len(held) >= per_block:
                yield block(held[:per_block])
                held = held[per_block:]
        if held:
            yield block(held)

    parts = max(1, min(2000, total // (per_block * 4)))
    ordered = lines.repartitionByRange(parts, "line").sortWithinPartitions("line")
    return written(ordered.mapInArrow(cut, "first_key string, last_key string, n_lines int, block binary"))


def find_captures(index: DataFrame, wanted: DataFrame) -> DataFrame:
    """(key, archive, segment, offset, length) of every capture of the wanted URL keys.

    wanted has (key, id): the URL key, and the page's id or null for all
    captures of that key. A key that isn't in the index gives no row.
    """
    # The directory has at most MAX_BLOCKS rows, and one or two more per partition of the index.
    directory = sorted((r.first_key, r.last_key) for r in index.select("first_key", "last_key").collect())
    firsts, lasts = [a for a, _ in directory], [b for _, b in directory]

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, at = [], []
            for key, page, every in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                prefix = f"{key}\t" if every else f"{key}\t{_id_text(page)}\t"
                low = bisect.bisect_left(lasts, prefix)
                high = bisect.bisect_left(firsts, prefix + "\U0010ffff")
                for b in range(low, high):
                    keys.append(prefix)
                    at.append(firsts[b])
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(at, pa.string())], names=["prefix", "first_key"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32())
        for batch in batches:
            rows = []
            for block, prefixes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                lines = zlib.decompress(block).decode().split("\n")
                for prefix in prefixes:
                    i = bisect.bisect_left(lines, prefix)
                    while i < len(lines) and lines[i].startswith(prefix):
                        key, _, archive, segment, offset, length = lines[i].split("\t")
                        rows.append((key, int(archive), int(segment), int(offset), int(length)))
                        i += 1
            columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=["key", "archive", "segment", "offset", "length"])

    located = wanted.select("key", F.col("id").cast("string").alias("id"), F.col("id").isNull().alias("every")).distinct().mapInArrow(locate, "prefix string, first_key string").distinct()
    # However many lookups a block gets, a row holds about LOOKUPS of them.
    parts = located.groupBy(F.col("first_key").alias("k")).agg(F.ceil(F.count(F.lit(1)) / LOOKUPS).cast("int").alias("parts"))
    dealt = located.join(parts, F.col("first_key") == F.col("k")).withColumn("part", F.pmod(F.xxhash64("prefix"), F.col("parts")))
    grouped = dealt.groupBy("first_key", "part").agg(F.collect_list("prefix").alias("prefixes"))
    return index.select("first_key", "block").join(grouped, "first_key").select("block", "prefixes").mapInArrow(search, "key string, archive int, segment int, offset int, length int")


def read_captures(archive: DataFrame, captures: DataFrame, *, id_type: str = "long") -> DataFrame:
    """Records at the captures' byte ranges, parsed.

    (record_id, payload_bytes, payload_digest, record_type, refers_to,
    refers_key, payload_ok): of a response, length and digest come from its
    bytes, and payload_ok says that they are those in its header; of a revisit
    they are stated only, see resolved(). Ids are stored as text and get the
    pages' id_type back.
    """
    ranges = captures.select("archive", "segment", "offset", "length").distinct().groupBy("archive", "segment").agg(F.sort_array(F.collect_list(F.struct("offset", "length"))).alias("ranges"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.bool_())
        for batch in batches:
            rows = []
            for data, wanted in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for r in wanted:
                    fields, payload = parse_record(gunzip_member(data[r["offset"] : r["offset"] + r["length"]]))
                    number = lambda name: _id_of(fields.get(name, "<urn:page:>")[10:-1])
                    stated, kind = (int(fields["x-payload-length"]), fields["warc-payload-digest"].removeprefix("sha256:")), fields["warc-type"]
                    got = (len(payload), hashlib.sha256(payload).hexdigest()) if kind == "response" else stated
                    key = _safe_key(fields.get("warc-refers-to-target-uri")) if kind == "revisit" else None
                    rows.append((number("warc-record-id"), *got, kind, number("warc-refers-to"), key, got == stated))
            columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=["record_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "refers_key", "payload_ok"])

    joined = archive.select("archive", "segment", "data").join(ranges, ["archive", "segment"]).select("data", "ranges")
    found = joined.mapInArrow(read, "record_id string, payload_bytes long, payload_digest string, record_type string, refers_to string, refers_key string, payload_ok boolean")
    return found.withColumns({c: F.col(c).cast(id_type) for c in ("record_id", "refers_to")})


def resolved(archive: DataFrame, index: DataFrame, records: DataFrame, *, id_type: str = "long") -> DataFrame:
    """records with the length and digest of revisits taken from the bytes of the responses that they refer to.

    (record_id, payload_bytes, payload_digest, record_type, refers_to). Bytes
    that aren't what a header states, and a missing response, raise an error.
    Responses are met by SALTS of their revisits' hashes, so that one that very
    many refer to is met in several places.
    """
    wanted = records.where("record_type = 'revisit'").select(F.col("refers_key").alias("key"), F.col("refers_to").alias("id")).distinct()
    origin = read_captures(archive, find_captures(index, wanted), id_type=id_type).where("record_type = 'response' and payload_ok")
    origin = origin.select(F.col("record_id").alias("o_id"), F.col("payload_bytes").alias("o_bytes"), F.col("payload_digest").alias("o_digest")).distinct()
    origin = written(origin).withColumn("o_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = records.withColumn("salt", F.pmod(F.xxhash64("record_id"), F.lit(SALTS)).cast("int"))
    same = (salted["refers_to"] == origin["o_id"]) & (salted["payload_digest"] == origin["o_digest"]) & (salted["payload_bytes"] == origin["o_bytes"]) & (salted["salt"] == origin["o_salt"])
    joined = salted.join(origin, same, "left")
    response = F.col("record_type") == "response"
    right = F.when(response, F.col("payload_ok")).otherwise(F.col("o_id").isNotNull())
    failed = F.raise_error(F.concat(F.lit("payload is not what its record states: page "), F.coalesce(F.col("record_id").cast("string"), F.lit("null"))))
    digest = F.when(~right, failed.cast("string")).when(response, F.col("payload_digest")).otherwise(F.col("o_digest"))
    return joined.select("record_id", F.when(response, F.col("payload_bytes")).otherwise(F.col("o_bytes")).alias("payload_bytes"), digest.alias("payload_digest"), "record_type", "refers_to")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record of the archives of `pages`, found through the index and read from its bytes."""
    archive = write_archive(with_revisits(table(spark, sf_dir, "pages")))
    index = build_index(archive)
    keys = archive.select(F.explode(F.split("lines", "\n")).alias("line")).select(F.substring_index("line", "\t", 1).alias("key"), F.expr("try_cast(split_part(line, '\t', 2) as bigint)").alias("id"))
    records = resolved(archive, index, written(read_captures(archive, find_captures(index, keys))))
    return records.select(F.col("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


OP7_SQL = f"""
with p as (select page_id, strlen(coalesce(html, '')) as payload_bytes, sha256(coalesce(html, '')) as payload_digest from pages),
f as (select payload_digest, min(page_id) as first_id from p where payload_bytes >= {MIN_REVISIT} group by payload_digest)
select page_id, payload_bytes::bigint as payload_bytes, payload_digest,
  case when first_id <> page_id then 'revisit' else 'response' end as record_type,
  case when first_id <> page_id then first_id end as refers_to
from p left join f using (payload_digest)
"""
