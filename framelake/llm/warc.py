"""WARC archives: a native writer, and a reader that splits files of any size and verifies the chain of records.

Reading. Spark's text source deals out byte ranges (blocks) of the files, with the line separator CR LF CR LF, so that a
header is one row. No task knows where the records of its block begin: payloads may hold anything, record magic too.
Each task lists every place that looks like a header at the start of a line, with the offset of the record that would
follow it, and follows these pointers as far as its own block goes (a candidate whose successor in the block is no
candidate is dead). Pointer jumping over the candidates then starts at offset 0 of each file and doubles its reach in
each round; rounds grow with the logarithm of a file's blocks. Candidates that it never reaches, such as magic inside a
payload, are dropped: what is kept of them is the place at which each block's chain begins. A second scan reads the
records from there. A record that runs over its block's end is put together from the blocks' fragments by a small
shuffle.

Writing. The text writer with the separator CR LF CR LF after each record; payloads pass as bytes. Of records with equal
payloads of at least `min_revisit_bytes` bytes, that with the largest id is the response and the others revisit it.

Defined cases: a null payload is the empty payload; a null URL gives a record without target; a null id compares as
the smallest and reads back as null; rows that repeat both the id and the payload of a response are responses too; an
empty table writes an archive without records and reads back no rows; further columns are ignored; a file that ends inside a
record loses that record alone.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framelake.llm.common import materialize, read, rows_of, scratch_path, ship

_GAP = b"\r\n\r\n"
_CRLF = "\r\n"
#: Blocks of which the chain's entries are broadcast at once (about 60 bytes each); more are read in groups of files.
MAX_BROADCAST_BLOCKS = 1_000_000
#: Repeated payloads up to this number are broadcast (about 80 bytes each); more are joined by a shuffle.
MAX_BROADCAST_DIGESTS = 500_000


def base32_sha1(payload):
    """Column: bare upper-case base32 of the SHA-1 of a binary column, from JVM functions: 5 hex digits are 4 of base 32."""
    digest = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digest, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def with_revisits(pages: DataFrame, min_revisit_bytes: int) -> DataFrame:
    """(id, url, payload) with payload_bytes, digest, record_type, refers_to. Only repeated payloads are joined."""
    rows = pages.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "digest": base32_sha1(F.col("payload"))})
    again = rows.where(F.col("payload_bytes") >= min_revisit_bytes).groupBy("digest").agg(F.count("*").alias("n"), F.max("id").alias("response_id")).where("n > 1").drop("n")
    again = materialize(again, "warc-repeated")
    again = F.broadcast(again) if again.count() <= MAX_BROADCAST_DIGESTS else again.hint("merge")  # payloads stay where they are if few repeat
    revisit = F.col("response_id").isNotNull() & ~F.col("id").eqNullSafe(F.col("response_id")) & (F.col("payload_bytes") >= min_revisit_bytes)
    return rows.join(again, "digest", "left").withColumns({"record_type": F.when(revisit, "revisit").otherwise("response"), "refers_to": F.when(revisit, F.col("response_id"))}).drop("response_id")


def write_warc(pages: DataFrame, path: str, *, id_col="page_id", url_col="url", payload_col="html", min_revisit_bytes: int = 0, date: str = "1970-01-01T00:00:00Z") -> None:
    rows = with_revisits(pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("payload")), min_revisit_bytes)
    is_revisit = F.col("record_type") == "revisit"
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    lines = [
        F.lit("WARC/1.0"),
        F.concat(F.lit("WARC-Type: "), F.col("record_type")),
        F.concat(F.lit("WARC-Record-ID: "), urn(F.col("id"))),
        F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace("url", r"[\r\n]", "%0A")),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
        F.concat(F.lit("X-Payload-Length: "), F.col("payload_bytes").cast("string")),
        F.when(is_revisit, F.concat(F.lit("WARC-Refers-To: "), urn(F.col("refers_to")))),
        F.when(is_revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest")),
        F.lit("Content-Type: text/html"),
        F.concat(F.lit("Content-Length: "), F.when(is_revisit, F.lit(0)).otherwise(F.col("payload_bytes")).cast("string")),
    ]
    header = F.concat_ws(_CRLF, *lines)  # leaves out nulls
    record = F.concat(header.cast("binary"), F.lit(_GAP), F.when(is_revisit, F.lit(b"")).otherwise(F.col("payload")))
    rows.select(record.cast("string").alias("record")).write.option("lineSep", _GAP.decode()).text(path)


def _header(text: bytes) -> dict[str, str] | None:
    """The fields of a header block, or None if it isn't one."""
    first, *lines = text.split(b"\r\n")
    if first not in (b"WARC/1.0", b"WARC/1.1"):
        return None
    fields = {}
    for line in lines:
        name, colon, value = line.partition(b":")
        if not colon:
            return None
        fields[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    return fields if fields.get("content-length", "").isdecimal() else None


def _magic(row: bytes):
    at = row.find(b"WARC/1.")
    while at >= 0:
        if at == 0 or row[at - 1] == 10:
            yield at
        at = row.find(b"WARC/1.", at + 1)


def _by_block(batches):
    """The text source's rows in runs of one block: (file, block, rows). A task's blocks follow each other."""
    key, run = None, None

    def rows():
        nonlocal ahead
        while ahead is not None and (ahead[0], ahead[1]) == key:
            value, ahead = ahead[2], next(feed, None)
            yield value

    feed = rows_of(batches, "file", "block", "value")
    ahead = next(feed, None)
    while ahead is not None:
        key = (ahead[0], ahead[1])
        run = rows()
        yield *key, run
        for _ in run:
            pass


_CANDIDATE = "file string, block long, start long, exit long, bytes long"


def _candidates(batches):
    """For each block a row with its bytes, and for each candidate where its chain leaves the block; offsets within the block."""
    for file, block, rows in _by_block(batches):
        at, successor = 0, {}
        for row in rows:
            for begin in _magic(row):
                if (fields := _header(row[begin:])) is not None:
                    successor[at + begin] = at + len(row) + len(_GAP) + int(fields["content-length"]) + len(_GAP)
            at += len(row) + len(_GAP)
        out: dict[int, int | None] = {}
        for start in reversed(successor):
            to = successor[start]
            out[start] = to if to >= at else out.get(to)
        starts = [s for s in out if out[s] is not None]
        n = len(starts) + 1
        columns = [[file] * n, [block] * n, [None, *starts], [None, *(out[s] for s in starts)], [at] + [None] * (n - 1)]
        kinds = [pa.string(), *[pa.int64()] * 4]
        yield pa.RecordBatch.from_arrays([*map(pa.array, columns, kinds)], ["file", "block", "start", "exit", "bytes"])


def _reach(pointers: DataFrame, rounds: int) -> DataFrame:
    """(file, start) of the candidates that the chain from offset 0 of their file reaches, by doubling."""
    reached = pointers.where("start = 0").select("file", "start").distinct()
    jump = pointers.select("file", F.col("start").alias("from"), F.col("exit").alias("to"))
    for k in range(rounds):
        step = reached.hint("merge").join(jump, (reached.file == jump.file) & (reached.start == jump["from"])).select(reached.file, F.col("to").alias("start"))
        reached = materialize(reached.union(step).distinct(), f"reached-{k}")
        if k + 1 < rounds:
            then = jump.select(F.col("file").alias("f"), F.col("from").alias("via"), F.col("to").alias("end"))
            jump = materialize(jump.hint("merge").join(then, (F.col("file") == F.col("f")) & (F.col("to") == F.col("via"))).select("file", "from", F.col("end").alias("to")), f"jump-{k}")
    return reached.hint("merge").join(pointers.select("file", "start"), ["file", "start"], "left_semi")


_RECORD = "file string, start long, key long, block long, header binary, payload binary, piece binary"


def _records(batches):
    """Whole records of a block from its entry on; pieces of those that cross its borders, by where the chain goes on."""
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
    names = ["file", "start", "key", "block", "header", "payload", "piece"]

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    def of_block(rows):
        """rows: (value, base, entry, after) of one block."""
        at, buffer, need, body, head, started = 0, bytearray(), 0, 0, [], False
        for value, base, entry, after in rows:
            chunk = value + _GAP
            if entry is None or at + len(chunk) <= entry - base:
                head.append(chunk)
            else:
                if not started:
                    started, skip = True, entry - base - at
                    head.append(chunk[:skip])
                    buffer += chunk[skip:]
                else:
                    buffer += chunk
                while True:
                    if not need:
                        if (body := buffer.find(_GAP)) < 0:
                            break
                        fields = _header(bytes(buffer[:body]))
                        if fields is None:
                            need = len(buffer) + 1  # the file ends in something else
                            break
                        need = body + len(_GAP) + int(fields["content-length"]) + len(_GAP)
                    if len(buffer) < need:
                        break
                    yield (None, base + at + len(chunk) - len(buffer), None, None, bytes(buffer[:body]), bytes(buffer[body + 4 : need - 4]), None)
                    del buffer[:need]
                    need = 0
            at += len(chunk)
        if head and (head := b"".join(head)):
            yield (None, None, after if entry is None else entry, None, None, None, head)
        if buffer:
            yield (None, None, after, None, None, None, bytes(buffer))

    out, size = [], 0
    feed = rows_of(batches, "file", "block", "value", "base", "entry", "after")
    ahead = next(feed, None)
    while ahead is not None:
        file, block = ahead[0], ahead[1]

        def run(file=file, block=block):
            nonlocal ahead
            while ahead is not None and (ahead[0], ahead[1]) == (file, block):
                row, ahead = ahead[2:], next(feed, None)
                yield row

        for row in of_block(run()):
            out.append((file, *row[1:3], block, *row[4:]))
            size += sum(len(x) for x in row[4:] if x)
            if size > 8_000_000:
                yield batch_of(out)
                out, size = [], 0
    if out:
        yield batch_of(out)


def _joined(table: pa.Table) -> pa.Table:
    """The record that pieces of several blocks make up; nothing if the file ends before it does."""
    pieces = sorted(zip(table["block"].to_pylist(), table["piece"].to_pylist(), strict=True))
    data = b"".join(p for _, p in pieces)
    body = data.find(_GAP)
    fields = _header(data[:body]) if body >= 0 else None
    whole = fields is not None and len(data) >= body + 4 + int(fields["content-length"])
    rows = [(table["file"][0].as_py(), data[:body], data[body + 4 : body + 4 + int(fields["content-length"])])] if whole else []
    return pa.table({n: pa.array([r[i] for r in rows], k) for i, (n, k) in enumerate([("file", pa.string()), ("header", pa.binary()), ("payload", pa.binary())])})


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """A row for each record: file, record_id, record_type, target_uri, refers_to, declared_digest, declared_bytes, payload."""
    ship(spark)
    rows = spark.read.option("lineSep", _GAP.decode()).text(path).select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    found = materialize(rows.mapInArrow(_candidates, _CANDIDATE), "warc-candidates")
    in_order = Window.partitionBy("file").orderBy("block")
    blocks = found.where("bytes is not null").select("file", "block", "bytes").withColumn("base", F.sum("bytes").over(in_order) - F.col("bytes"))
    pointers = found.where("bytes is null").hint("merge").join(blocks.drop("bytes"), ["file", "block"]).select("file", "block", (F.col("base") + F.col("start")).alias("start"), (F.col("base") + F.col("exit")).alias("exit"))
    n_blocks, longest = blocks.groupBy("file").count().agg(F.coalesce(F.sum("count"), F.lit(0)), F.coalesce(F.max("count"), F.lit(1))).first()
    if longest > 1:
        pointers = materialize(pointers, "warc-pointers")
    reached = _reach(pointers, math.ceil(math.log2(longest)))
    entries = pointers.hint("merge").join(reached, ["file", "start"], "left_semi").groupBy("file", "block").agg(F.min("start").alias("entry"))
    ahead = in_order.rowsBetween(1, Window.unboundedFollowing)
    begins = blocks.join(entries, ["file", "block"], "left").withColumn("after", F.coalesce(F.min("entry").over(ahead), F.lit(-1).cast("long"))).drop("bytes")
    begins = materialize(begins, "warc-blocks")
    groups = max(1, math.ceil(n_blocks / MAX_BROADCAST_BLOCKS))
    parts = []
    for group in range(groups):
        mine = lambda df, group=group: df.where(F.pmod(F.xxhash64("file"), F.lit(groups)) == group) if groups > 1 else df
        # as long as the number of blocks, which is bounded above; the rows of a block keep their order
        joined = mine(rows).join(F.broadcast(mine(begins)), ["file", "block"], "left")
        known = F.when(F.col("base").isNotNull(), F.col("base")).otherwise(F.raise_error(F.lit("the files were split differently in the second scan")).cast("long"))
        parts.append(joined.withColumn("base", known).select("file", "block", "value", "base", "entry", "after").mapInArrow(_records, _RECORD))
    records = parts[0]
    for part in parts[1:]:
        records = records.union(part)
    crossing = longest > 1
    whole = records.where("piece is null").select("file", "header", "payload")
    if crossing:
        pieces = records.where("piece is not null").groupBy("file", "key").applyInArrow(_joined, "file string, header binary, payload binary")
        whole = whole.union(pieces)
    text = F.col("header").cast("string")
    field = lambda name: F.nullif(F.regexp_extract(text, rf"(?i)(?:^|\n){name}:[ \t]*([^\r\n]*)", 1), F.lit(""))
    return whole.select(
        "file",
        field("WARC-Record-ID").alias("record_id"), field("WARC-Type").alias("record_type"), field("WARC-Target-URI").alias("target_uri"), field("WARC-Refers-To").alias("refers_to"),
        F.regexp_replace(field("WARC-Payload-Digest"), "^sha1:", "").alias("declared_digest"), field("X-Payload-Length").cast("long").alias("declared_bytes"), "payload",
    )


def resolve_revisits(records: DataFrame) -> DataFrame:
    """records of read_warc; a revisit without a declared length, as in archives of others, takes that of the response that it refers to, if that is there."""
    lengths = records.where("record_type = 'response'").groupBy(F.col("record_id").alias("refers_to")).agg(F.max(F.octet_length("payload").cast("long")).alias("response_bytes"))
    found = records.join(lengths, "refers_to", "left").withColumn("declared_bytes", F.coalesce("declared_bytes", F.when(F.col("record_type") == "revisit", F.col("response_bytes"))))
    return found.select(*records.columns)


def op1_warc(spark, sf_dir):
    path = scratch_path(spark, "warc")
    write_warc(read(spark, sf_dir, "pages"), path)
    records = read_warc(spark, path)
    number = lambda c: F.nullif(F.regexp_extract(c, r"<urn:page:(-?\d*)>", 1), F.lit("")).cast("long")
    revisit = F.col("record_type") == "revisit"
    return records.select(
        number("record_id").alias("page_id"),
        F.when(revisit, F.col("declared_bytes")).otherwise(F.octet_length("payload").cast("long")).alias("payload_bytes"),
        F.when(revisit, F.col("declared_digest")).otherwise(base32_sha1(F.col("payload"))).alias("payload_digest"),
        "record_type",
        number("refers_to").alias("refers_to"),
    )


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, html, octet_length(encode(html))::BIGINT AS payload_bytes, sha1(html) AS h FROM p),
e AS (SELECT page_id, html, payload_bytes, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, 5 * (i // 4) + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INTEGER, 1)), '') AS payload_digest FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = m THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> m THEN m END AS refers_to
FROM (SELECT *, max(page_id) OVER (PARTITION BY html) AS m FROM e)
"""
