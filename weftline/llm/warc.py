"""WARC archives through Spark's own text writer and reader, and the assembly of captures from their records."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import looked_up, written

#: Fixed values of the format.
CRLF, END, START = "\r\n", "\r\n\r\n", "\r\n\r\nWARC/1."
#: Payloads below this many bytes are always stored.
LEAST_REVISIT = 1000
MAIN = ("response", "revisit", "resource")
DATE = "2024-01-01T00:00:00Z"
SALTS = 32


def record_id(kind: str, key: Column) -> Column:
    h = F.sha1(F.concat(F.lit(kind + ":"), key))
    return F.concat(F.lit("<urn:uuid:"), *(x for a, n in ((1, 8), (9, 4), (13, 4), (17, 4)) for x in (F.substring(h, a, n), F.lit("-"))), F.substring(h, 21, 12), F.lit(">"))


def _key(page_id: Column, url: Column, digest: Column) -> Column:
    return F.concat_ws("|", F.coalesce(page_id.cast("string"), F.lit("null")), F.coalesce(url, F.lit("null")), digest)


def _record(kind: Column, rid: Column, uri: Column, block: Column, content: Column | str, *more: Column) -> Column:
    """One record without its ending, which the writer adds as line separator."""
    content = F.lit(content) if isinstance(content, str) else content
    head = [F.lit("WARC/1.1\r\nWARC-Type: "), kind, F.lit("\r\nWARC-Record-ID: "), rid, F.lit(f"\r\nWARC-Date: {DATE}\r\nWARC-Target-URI: "), uri]
    return F.concat(*head, *more, F.lit("\r\nContent-Type: "), content, F.lit("\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit(END), block)


def plan_revisits(pages: DataFrame) -> DataFrame:
    """page_id, url, html, bytes, digest and ``first``: the struct of the page that stores an equal payload, else null.

    Digests are counted with map-side partial aggregation; those met twice or more are joined back
    with their pages' rows dealt over SALTS parts of a digest, so that one payload with a third of
    all pages does not meet in one task.
    """
    p = pages.select("page_id", F.regexp_replace(F.coalesce("url", F.lit("")), "[\\r\\n ]", "").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    p = p.select("*", F.octet_length("html").cast("long").alias("bytes"), F.sha1(F.col("html").cast("binary")).alias("digest"))
    first = p.where(F.col("bytes") >= LEAST_REVISIT).groupBy("digest").agg(F.max(F.struct("page_id", "url")).alias("first"), F.count("*").alias("n")).where("n > 1")
    many = first.select(F.col("digest").alias("d"), "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("s"))
    dealt = p.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
    return dealt.join(many, (dealt["digest"] == many["d"]) & (dealt["salt"] == many["s"]), "left").drop("d", "s", "salt", "n")


def write_warc(pages: DataFrame, path: str) -> None:
    """Write request, response or revisit, and metadata records of every page as gzip archives.

    Spark's text writer ends each record with CRLF CRLF, just as the format asks, and works on any
    file system that Spark writes to. Nulls: a null html is an empty payload, a null url an empty one.
    """
    p = plan_revisits(pages)
    key = _key(F.col("page_id"), F.col("url"), F.col("digest"))
    again = F.col("first").isNotNull() & F.col("first.page_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first.page_id"))
    main = record_id("main", key)
    refers = record_id("main", _key(F.col("first.page_id"), F.col("first.url"), F.col("digest")))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit(END))
    digest = F.concat(F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("digest"))
    revisit = F.concat(F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: "), refers)
    host, where = F.regexp_extract("url", "^[a-z]+://([^/]*)", 1), F.regexp_extract("url", "^[a-z]+://[^/]*(.*)$", 1)
    get = F.concat(F.lit("GET "), F.when(where == "", "/").otherwise(where), F.lit(" HTTP/1.1\r\nHost: "), host, F.lit(END))
    with_main = F.concat(F.lit("\r\nWARC-Concurrent-To: "), main)
    meta = F.concat(F.lit("page-id: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(CRLF))
    records = F.array(
        _record(F.lit("request"), record_id("request", key), F.col("url"), get, "application/http; msgtype=request", with_main),
        _record(F.when(again, "revisit").otherwise("response"), main, F.col("url"), F.concat(http, F.when(again, "").otherwise(F.col("html"))), "application/http; msgtype=response", digest, F.when(again, revisit).otherwise("")),
        _record(F.lit("metadata"), record_id("metadata", key), F.col("url"), meta, "application/warc-fields", with_main),
    )
    p.select(F.explode(records).alias("value")).write.option("lineSep", END).option("compression", "gzip").text(path)


RECORD = "record_id string, type string, concurrent_to array<string>, refers_to string, uri string, date string, digest string, payload_bytes long, payload_digest string, fields map<string,string>, payload binary"
_SCHEMA = pa.schema(
    [("record_id", pa.string()), ("type", pa.string()), ("concurrent_to", pa.list_(pa.string())), ("refers_to", pa.string()), ("uri", pa.string()), ("date", pa.string()), ("digest", pa.string()),
     ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("fields", pa.map_(pa.string(), pa.string())), ("payload", pa.binary())]
)


def parse(record: bytes, payloads: bool) -> tuple:
    """One whole record (without its ending) to a row of RECORD."""
    head, _, block = record.partition(b"\r\n\r\n")
    names: dict[str, str] = {}
    conc: list[str] = []
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        name, value = name.strip().lower(), value.strip()
        if name == "warc-concurrent-to":
            conc.append(value)
        names[name] = value
    block = block[: int(names.get("content-length", len(block)))]
    kind, fields, body, size, sha = names.get("warc-type"), [], block, len(block), None
    if names.get("content-type", "").startswith("application/http"):
        http, _, body = block.partition(b"\r\n\r\n")
        size = len(body)
        if kind == "revisit":
            told = [x for x in http.lower().split(b"\r\n") if x.startswith(b"content-length:")]
            size = int(told[0].split(b":")[1]) if told else None
    elif names.get("content-type") == "application/warc-fields":
        fields = list(dict(x.split(": ", 1) for x in block.decode("utf-8", "replace").split("\r\n") if ": " in x).items())
    if kind in MAIN:
        sha = names.get("warc-payload-digest", "").removeprefix("sha1:") if kind == "revisit" else hashlib.sha1(body).hexdigest()
    return (names.get("warc-record-id"), kind, conc, names.get("warc-refers-to"), names.get("warc-target-uri"), names.get("warc-date"), names.get("warc-payload-digest"), size, sha, fields, body if payloads else None)


def record_size(piece: bytes) -> int | None:
    """Bytes of the record that a piece begins with, by its Content-Length (all without one); null if the piece ends before."""
    head = piece.find(b"\r\n\r\n")
    if head < 0:
        return None
    low = piece[:head].lower()
    at = low.find(b"\r\ncontent-length:")
    size = head + 4 + int(low[at + 17 :].split(b"\r\n")[0]) if at >= 0 else len(piece)
    return size if size <= len(piece) else None


def read_warc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """All records of the archives under ``path`` (RECORD); ``payloads`` false leaves bodies out, not their digests.

    Spark's text reader streams a gzip archive, of any size and with one or many members, cut where
    a record seems to begin; a piece shorter than its Content-Length was cut inside its body and
    takes the next pieces of the same file, which follow it in the same task. The text reader may miss
    a cut where its buffer ends inside CRLFs, so a piece that goes on after its Content-Length with
    another record is read on. Archives must be compressed by gzip, which Spark never splits. Memory
    holds one record and one Arrow batch. Digests are of the bytes read, for revisits as declared.
    """
    pieces = spark.read.option("lineSep", START).text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("value"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, weight = [], 0
        held, file = b"", None
        for batch in batches:
            for name, piece in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if name != file and held:
                    rows.append(parse(held, payloads))
                    held = b""
                if held:
                    piece = held + START.encode() + piece
                elif not piece.startswith(b"WARC/1."):
                    piece = b"WARC/1." + piece
                held, file = b"", name
                while piece:
                    size = record_size(piece)
                    if size is None:
                        held = piece
                        break
                    rows.append(parse(piece[:size], payloads))
                    weight += size if payloads else 200
                    rest = piece[size:]
                    piece = rest[len(END) :] if rest.startswith(START.encode()) else b""
                if len(rows) >= 2000 or weight > 1 << 23:
                    yield _batch(rows)
                    rows, weight = [], 0
        if held:
            rows.append(parse(held, payloads))
        if rows:
            yield _batch(rows)

    return pieces.mapInArrow(run, RECORD)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _SCHEMA)], schema=_SCHEMA)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row a capture: capture_id, main, requests, metadata, others.

    Records are joined through WARC-Concurrent-To, in either direction, to a response, revisit or
    resource record, directly or over one more record in between. A record that reaches none is a
    capture of its own without main. A record that names several mains goes to the one with the
    least id; links to missing records are ignored; repeated record ids stay as they are, several
    mains of one id in ``mains``. Only ids move in the joins. A capture's records meet in one row,
    which is the result asked for.
    """
    ids = records.select("record_id", "type", "concurrent_to")
    main = ids.where(F.col("type").isin(*MAIN)).select(F.col("record_id").alias("main")).distinct()
    links = ids.select(F.col("record_id").alias("a"), F.explode("concurrent_to").alias("b")).distinct()
    links = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    rest = ids.where(~F.col("type").isin(*MAIN)).select(F.col("record_id").alias("a")).distinct()
    near = links.join(main, links["b"] == main["main"]).groupBy("a").agg(F.min("main").alias("one"))
    step = links.join(near.withColumnRenamed("a", "b"), "b").groupBy("a").agg(F.min("one").alias("two"))
    home = rest.join(near, "a", "left").join(step, "a", "left").select(F.col("a").alias("record_id"), F.coalesce("one", "two", "a").alias("home"))
    placed = records.join(home, "record_id", "left").withColumn("capture_id", F.coalesce("home", "record_id")).drop("home")
    whole = F.struct(*records.columns)
    of = lambda *kinds: F.collect_list(F.when(F.col("type").isin(*kinds), whole))
    other = F.collect_list(F.when(~F.col("type").isin(*MAIN, "request", "metadata"), whole))
    grouped = placed.groupBy("capture_id").agg(of(*MAIN).alias("mains"), of("request").alias("requests"), of("metadata").alias("metadata"), other.alias("others"))
    return grouped.withColumn("main", F.get("mains", F.lit(0)))


def pages_through_warc(pages: DataFrame, path: str) -> DataFrame:
    """Write the pages as archives under ``path``, read them back, assemble captures, and resolve revisits.

    (page_id, payload_bytes, payload_digest, record_type, refers_to) for each page: refers_to is the
    page id of the record that a revisit names, found among the captures read; one response may be
    named by any share of all revisits. Of pages that repeat the largest id of a payload each is a
    response. An empty table gives no rows. A payload is one string in one task, so at most 2 GB.
    """
    write_warc(pages, path)
    captures = assemble(read_warc(pages.sparkSession, path, payloads=False))
    flat = written(
        captures.where("main is not null").select(F.expr("nullif(metadata[0].fields['page-id'], '')").cast("long").alias("page_id"), F.explode("mains").alias("m")).select("page_id", "m.record_id", "m.type", "m.payload_bytes", "m.payload_digest", "m.refers_to"),
        "captures",
    )
    stored = flat.where("type = 'response'").groupBy(F.col("record_id").alias("refers_to")).agg(F.max("page_id").alias("target"))
    return looked_up(flat, "refers_to", stored).select("page_id", "payload_bytes", "payload_digest", F.col("type").alias("record_type"), F.col("target").alias("refers_to"))
