"""WARC archives: write pages as records, read records back without trusting what looks like one.

Writing. A record is text, so Spark's text writer makes the archives: one file per task, a record per
row, the blank lines after a record as the line separator. The first page of a payload is a
``response``; later ones are ``revisit`` records that refer to it and carry no payload. First means the
least page id; rows that repeat it are responses too, null ids come last and a null id is never
referred to. Null html is an empty payload. Only digests and ids are shuffled; pages meet
them in a join that Spark makes a broadcast when few pages repeat.

Reading. Files are read in splits, cut at every occurrence of the record magic. A piece that
starts with a complete header is a candidate and names the offset at which the next record must
begin. Magic may also occur inside a payload, so candidates are only believed if the chain
of successors from the start of the file leads to them. Runs of candidates in which each is the
successor of the one before are found inside a split; the chain over runs is then followed by
pointer jumping, which takes the logarithm of the number of runs. A record that spans several
pieces is put together from them afterwards.

Only offsets and numbers are shuffled for that; payloads stay in the scan, except for records that
contain the magic. A file without a readable first header gives no record. Repeated
rows give repeated records. An empty table gives no archive and no records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import drop_shared, scratch, write_shared

MAGIC, BREAK = "WARC/1.0\r\n", "\r\n\r\n"
_NAMES = {
    "page_id": "WARC-Page-Id", "record_type": "WARC-Type", "url": "WARC-Target-URI", "refers_to": "WARC-Refers-To-Page-Id",
    "declared_digest": "WARC-Payload-Digest", "declared_bytes": "WARC-Payload-Length",
}


def base32_sha1(data: Column) -> Column:
    """Upper-case base32 of the SHA-1: five hex digits are four letters."""
    h = F.sha1(data)
    letters = [F.lpad(F.conv(F.substring(h, 5 * k + 1, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*letters), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0) -> None:
    """One record per row of ``pages`` (page_id, url, html) into text archives under ``folder``.

    Payloads of fewer than ``min_bytes`` bytes are always responses.
    """
    html = F.coalesce("html", F.lit(""))
    p = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"),
        F.octet_length(html).cast("long").alias("bytes"), base32_sha1(html.cast("binary")).alias("digest"),
    )
    first = p.where(F.col("bytes") >= min_bytes).groupBy("digest", "bytes").agg(
        F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")
    ).where("n > 1 AND first IS NOT NULL").drop("n")
    repeated = write_shared(first, "repeated-payloads")
    p = p.join(repeated, ["digest", "bytes"], "left")
    again = F.coalesce(~F.col("first").eqNullSafe(F.col("page_id")), F.lit(False)) & F.col("first").isNotNull()
    kind = F.when(again, "revisit").otherwise("response")
    body = F.when(again, F.lit("")).otherwise(F.col("html"))
    clean = F.regexp_replace("url", r"[\x00-\x1f\x7f]", " ")

    def field(name: str, value: Column) -> Column:
        return F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n")), F.lit(""))

    record = F.concat(
        F.lit(MAGIC), field("WARC-Type", kind),
        field("WARC-Record-ID", F.concat(F.lit("<urn:uuid:"), _uuid(F.concat_ws("/", F.col("page_id").cast("string"), "digest")), F.lit(">"))),
        field("WARC-Page-Id", F.col("page_id")), field("WARC-Target-URI", clean),
        field("WARC-Refers-To-Page-Id", F.when(again, F.col("first"))),
        field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))), field("WARC-Payload-Length", F.col("bytes")),
        field("Content-Type", F.lit("text/html; charset=utf-8")), field("Content-Length", F.octet_length(body)),
        F.lit("\r\n"), body,
    )
    p.select(record.alias("value")).write.option("lineSep", BREAK).text(folder)


def _uuid(text: Column) -> Column:
    h = F.md5(text.cast("binary"))
    return F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


def _pieces(spark: SparkSession, folder: str) -> DataFrame:
    """(file, split, row, value): the text between occurrences of the magic, in file order by (split, row).

    The first piece of a file is what stands before its first magic. ``row`` is stable, because
    the splits of unchanged files are.
    """
    return spark.read.option("lineSep", MAGIC).text(folder).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("row"), "value",
    )


def _header(value: Column) -> Column:
    """The header of a piece up to the blank line, null without one."""
    return F.when(F.instr(value, BREAK) > 0, F.substring_index(value, BREAK, 1))


def _field(header: Column, name: str) -> Column:
    found = F.regexp_extract(header, rf"(?im)^{name}:[ \t]*(.*?)[ \t]*\r?$", 1)
    return F.when(found != "", found)


def _candidates(spark: SparkSession, folder: str) -> DataFrame:
    """A narrow row per piece: where it lies, where its record would end, and what it says."""
    p = _pieces(spark, folder)
    raw = p.withColumn("header", _header(F.col("value")))
    length = _field(F.col("header"), "Content-Length")
    raw = raw.withColumns({
        "size": F.octet_length("value").cast("long"),
        "content": F.when(length.rlike("^[0-9]{1,15}$"), length.cast("long")),
        "skip": (F.octet_length("header") + len(BREAK)).cast("long"),
    })
    # A record ends with its payload and a blank line; one that fits its piece is digested here.
    raw = raw.withColumn("whole", F.coalesce(F.col("skip") + F.col("content") + len(BREAK) <= F.col("size"), F.lit(False)))
    payload = F.substring(F.col("value").cast("binary"), F.col("skip").cast("int") + 1, F.col("content").cast("int"))
    return raw.select(
        "file", "split", "row", "size", "skip", "content", "whole",
        *[_field(F.col("header"), h).alias(n) for n, h in _NAMES.items()],
        F.when(F.col("whole"), base32_sha1(payload)).alias("digest"),
    )


def _laid_out(cand: DataFrame) -> DataFrame:
    """Pieces with ``offset``, that of the magic before them, and ``end``, where their record would end."""
    # Sizes inside a split, plus the totals of the splits before. A file's first piece has no magic
    # before it and gets a negative offset.
    in_split = Window.partitionBy("file", "split").orderBy("row")
    c = cand.withColumn("_upto", F.sum(F.col("size") + len(MAGIC)).over(in_split.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    totals = c.groupBy("file", "split").agg(F.max("_upto").alias("_total")).select(
        "file", "split", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_before")
    )
    c = c.join(totals, ["file", "split"]).withColumn("offset", F.col("_before") + F.col("_upto") - F.col("size") - 2 * len(MAGIC))
    c = c.withColumn("end", F.col("offset") + len(MAGIC) + F.col("skip") + F.col("content") + len(BREAK))
    return c.drop("_upto", "_before")


def _reachable(laid: DataFrame) -> DataFrame:
    """The records of ``laid`` that the chain from offset 0 of their file reaches."""
    in_split = Window.partitionBy("file", "split").orderBy("row")
    c = laid.where("offset >= 0 AND content IS NOT NULL")
    starts_run = F.coalesce(F.lag("end").over(in_split) != F.col("offset"), F.lit(True))
    c = c.withColumn("_s", F.when(starts_run, F.col("offset"))).withColumn(
        "run", F.last("_s", ignorenulls=True).over(in_split.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ).drop("_s")
    c = write_shared(c, "warc-candidates")
    # A run leads to the run that holds the successor of its last record.
    ends = c.groupBy("file", "run").agg(F.max("end").alias("end"))
    jumps = write_shared(ends.join(
        c.select("file", F.col("offset").alias("end"), F.col("run").alias("next")), ["file", "end"]
    ).select("file", "run", "next"), "warc-jumps")
    first = c.where("offset = 0").select("file", "run").distinct()
    reached = write_shared(first, "warc-reached")
    while not jumps.isEmpty():
        hop = reached.join(jumps, ["file", "run"]).select("file", F.col("next").alias("run"))
        grown = write_shared(reached.unionByName(hop).distinct(), "warc-reached")
        onward = jumps.select("file", F.col("run").alias("next"), F.col("next").alias("after"))
        doubled = write_shared(
            jumps.join(onward, ["file", "next"]).select("file", "run", F.col("after").alias("next")), "warc-jumps"
        )
        drop_shared(reached)
        drop_shared(jumps)
        reached, jumps = grown, doubled
    # A run may be entered behind its start; what lies before the entry was not reached.
    entered = ends.join(reached, ["file", "run"], "left_semi").select("file", F.col("end").alias("offset"))
    entries = c.select("file", "run", "offset").join(entered, ["file", "offset"]).select("file", "run", "offset")
    entries = entries.unionByName(first.withColumn("offset", F.lit(0).cast("long"))).groupBy("file", "run").agg(
        F.min("offset").alias("entry")
    )
    return c.join(entries, ["file", "run"]).where(F.col("offset") >= F.col("entry")).drop("run", "entry")


def _spanning(pieces: DataFrame, laid: DataFrame, records: DataFrame) -> DataFrame:
    """(file, offset, digest) of ``records`` whose payload contains the magic, put together from their pieces."""
    grain = F.lit(1 << 20)  # pieces and records meet on megabytes of a file
    at = lambda c: F.floor(F.col(c) / grain)
    wide = records.select(
        "file", F.col("offset").alias("start"), "end", "skip", "content", F.explode(F.sequence(at("offset"), at("end"))).alias("_g")
    )
    needed = laid.select("file", "split", "row", "offset", at("offset").alias("_g")).join(wide, ["file", "_g"]).where(
        "offset >= start AND offset < end"
    ).drop("_g", "end")
    text = pieces.join(needed, ["file", "split", "row"]).groupBy("file", "start").agg(
        F.max("skip").alias("skip"), F.max("content").alias("content"),
        F.array_sort(F.collect_list(F.struct("offset", "value"))).alias("parts"),  # as long as the record itself
    )
    whole = F.array_join(F.transform("parts", lambda x: x["value"]), MAGIC).cast("binary")
    payload = F.substring(whole, F.col("skip").cast("int") + 1, F.col("content").cast("int"))
    return text.select("file", F.col("start").alias("offset"), payload.alias("payload"))


def read_archives(spark: SparkSession, folder: str, with_payload: bool = False) -> DataFrame:
    """One row per record: page_id, url, record_type, refers_to, payload_bytes, payload_digest, file, offset.

    Bytes and digest are those of the full payload: measured for responses, and for revisits those
    of the response with the payload they declare, or as declared if no archive holds it. ``with_payload`` adds
    the bytes of each response.
    """
    laid = write_shared(_laid_out(_candidates(spark, folder)), "warc-pieces")
    records = write_shared(_reachable(laid), "warc-records")
    split_up = records.where("NOT whole")
    if not split_up.isEmpty():
        joined = _spanning(_pieces(spark, folder), laid, split_up)
        digests = joined.select("file", "offset", base32_sha1(F.col("payload")).alias("_d"))
        records = write_shared(
            records.join(digests, ["file", "offset"], "left").withColumn("digest", F.coalesce("digest", "_d")).drop("_d"), "warc-records"
        )
    declared = F.regexp_replace("declared_digest", "^sha1:", "")
    is_revisit = F.col("record_type") == "revisit"
    held = records.where(~is_revisit).groupBy("digest").agg(F.max("content").alias("_bytes")).withColumnRenamed("digest", "_digest")
    out = records.withColumn("_digest", F.when(is_revisit, declared)).join(held, "_digest", "left")
    out = out.select(
        F.col("page_id").cast("long").alias("page_id"), "url", "record_type", F.col("refers_to").cast("long").alias("refers_to"),
        F.when(is_revisit, F.coalesce("_bytes", F.col("declared_bytes").cast("long"))).otherwise(F.col("content")).alias("payload_bytes"),
        F.when(is_revisit, F.col("_digest")).otherwise(F.col("digest")).alias("payload_digest"), "file", "offset",
    )
    if not with_payload:
        return out
    pieces = _pieces(spark, folder)
    inside = records.where("whole").select("file", "split", "row", "offset", "skip", "content").join(pieces, ["file", "split", "row"])
    payloads = inside.select(
        "file", "offset", F.substring(F.col("value").cast("binary"), F.col("skip").cast("int") + 1, F.col("content").cast("int")).alias("payload")
    ).unionByName(_spanning(pieces, laid, split_up).select("file", "offset", "payload"))
    return out.join(payloads, ["file", "offset"], "left")


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write ``pages`` as archives into the shared folder and read them back."""
    spark = pages.sparkSession
    folder = scratch(spark, "warc")
    write_archives(pages, folder, min_bytes)
    return read_archives(spark, folder)
