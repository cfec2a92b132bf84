"""WARC archives: written and read back with boundary-chain verification.

Writing: payloads are digested; of equal payloads of at least REVISIT_BYTES bytes the smallest page
is a `response`, the others `revisit` it without a payload of their own. Archives are plain text files
of Spark's writer (each a single gzip member), one record after the other, in the shared folder.

Reading: the stream is cut at every place where the record magic stands, also inside payloads. Each
such candidate names its successor: its own place plus header and Content-Length. From the file's
start the chain of successors is followed by pointer jumping (pointers double each round), and only
reachable candidates are records; magic inside a payload is not. A record whose payload holds the
magic is put together again from its pieces.

Archives that Spark would split (uncompressed ones over several tasks) are refused when they are read.

Cases: a null html is an empty payload; rows with a null page_id are written under their digest as an
id and come back with a null page_id, always as response; repeated rows of one page_id: equal payloads
are one page's, so none revisits itself; an empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.llm.common import shared_dir, stored, table

MAGIC, END = "WARC/1.1\r\n", "\r\n\r\n"
REVISIT_BYTES = 100
#: Records a file holds at most, which bounds what one chain is.
FILE_RECORDS = 5000
#: A revisit of an equal payload (a fixed value of the standard), and when records say they were made.
PROFILE, DATE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "2024-01-01T00:00:00Z"
FIELDS = ("WARC-Type", "WARC-Record-ID", "WARC-Refers-To", "WARC-Payload-Digest", "X-Payload-Length", "Content-Length")


def write_warc(pages: DataFrame, path: str, date: str = DATE) -> None:
    """pages: page_id, url, html. One record a row, in Spark's text files under path."""
    payload = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), payload.alias("payload"), F.octet_length(payload).alias("size"), F.sha2(payload.cast("binary"), 256).alias("digest"))
    #: The first page of each payload that repeats; partial minima are made before the shuffle.
    firsts = rows.filter(F.col("page_id").isNotNull() & (F.col("size") >= REVISIT_BYTES)).groupBy("digest").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last")).filter("first <> last")
    joined = rows.join(firsts.select("digest", "first"), "digest", "left")
    revisit = F.col("first").isNotNull() & (F.col("size") >= REVISIT_BYTES) & (F.col("page_id") != F.col("first"))
    field = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    uri = lambda c: F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(">"))
    header = F.concat(
        F.lit(MAGIC),
        field("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        field("WARC-Record-ID", F.coalesce(uri(F.col("page_id")), F.concat(F.lit("<urn:sha256:"), "digest", F.lit(">")))),
        field("WARC-Date", F.lit(date)),
        F.coalesce(field("WARC-Target-URI", F.regexp_replace("url", r"[\r\n]", "")), F.lit("")),
        F.when(revisit, F.concat(field("WARC-Profile", F.lit(PROFILE)), field("WARC-Refers-To", uri(F.col("first"))))).otherwise(""),
        field("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "digest")),
        field("X-Payload-Length", F.col("size").cast("string")),
        field("Content-Length", F.when(revisit, F.lit(0)).otherwise(F.col("size")).cast("string")),
        F.lit("\r\n"),
    )
    record = F.concat(header, F.when(revisit, "").otherwise(F.col("payload")))
    joined.select(record.alias("value")).write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", FILE_RECORDS).text(path)


def pieces(spark: SparkSession, path: str, text: bool = False) -> DataFrame:
    """(file, at, ...): the stream cut at every magic; gzip files are read whole by one task, in order.

    A candidate's row has its place, the end of its content, its fields, and the digest of its payload where
    the piece holds all of it; with text, the piece itself. Ids stay text, which pandas keeps exact.
    """
    cut = spark.read.option("lineSep", MAGIC).text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("from"))
    split = F.instr("value", END)
    head = F.substring("value", F.lit(1), split - 1)
    named = {f: F.nullif(F.regexp_extract(head, rf"(?:^|\r\n){f}: ([^\r\n]*)", 1), F.lit("")) for f in FIELDS}
    size = F.octet_length("value")
    head_size = F.when(split > 0, F.octet_length(head) + len(END))
    length = named["Content-Length"].try_cast("long")
    body = F.substring(F.col("value").cast("binary"), head_size + 1, length.try_cast("int"))
    page = lambda f: F.regexp_extract(named[f], r"^<urn:page:(-?[0-9]+)>$", 1)
    rows = cut.select(
        "file", "from", size.cast("long").alias("size"), (head_size + length).alias("content"), head_size.alias("head"), length.alias("length"),
        named["WARC-Type"].alias("kind"), page("WARC-Record-ID").alias("page_id"), page("WARC-Refers-To").alias("refers_to"),
        named["X-Payload-Length"].alias("told_bytes"), F.substring(named["WARC-Payload-Digest"], 8, 64).alias("told_digest"),
        F.when((head_size + length + len(END)) == size, F.sha2(body, 256)).alias("digest"),
        *([F.col("value").cast("binary").alias("text")] if text else []),
    )

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Running places within each file; the first piece is what stands before the first magic: nothing."""
        file, at = None, 0
        for batch in batches:
            if (batch["from"] > 0).any():
                raise ValueError(f"{batch['file'].iloc[0]} was split; archives must be read whole (gzip them)")
            starts = np.empty(len(batch), np.int64)
            for i, (name, n) in enumerate(zip(batch["file"], batch["size"], strict=True)):
                if name != file:
                    file, at = name, -len(MAGIC)
                starts[i], at = at, at + int(n) + len(MAGIC)
            yield batch.assign(at=starts)

    return rows.mapInPandas(place, rows.schema.simpleString()[7:-1] + ",at:bigint")


def chain(rows: pd.DataFrame) -> pd.DataFrame:
    """Which candidates of a file the chain from its start reaches: pointer jumping over successor places."""
    rows = rows[rows["at"] >= 0].sort_values("at").reset_index(drop=True)
    at, n = rows["at"].to_numpy(), len(rows)
    to = (rows["at"] + len(MAGIC) + rows["content"] + len(END)).fillna(-1).to_numpy(np.int64)
    jump = np.searchsorted(at, to)
    jump[(jump == n) | (at[np.minimum(jump, n - 1)] != to)] = n  # n: no such candidate
    jump = np.append(jump, n)
    reached = np.zeros(n + 1, bool)
    reached[0] = n > 0
    while (jump[:n] != n).any():
        reached[jump[reached]] = True
        jump = jump[jump]
    reached = reached[:n]
    #: A piece that is no record belongs to the payload of the last record before it.
    return rows.assign(record=reached, owner=np.maximum.accumulate(np.where(reached, at, -1)))


def glued(rows: pd.DataFrame) -> pd.DataFrame:
    """The payload digest of one record whose payload spans several pieces, the magic between them."""
    rows = rows.sort_values("at")
    first = rows.iloc[0]
    data = MAGIC.encode().join(rows["text"])[int(first["head"]) :][: int(first["length"])]
    return pd.DataFrame({"file": [first["file"]], "at": [first["at"]], "glued": [hashlib.sha256(data).hexdigest()]})


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """One row a record: page_id, record_type, payload_bytes, payload_digest (of the payload as read; a revisit's as told), refers_to."""
    rows = pieces(spark, path)
    marked = stored(rows.groupBy("file").applyInPandas(chain, rows.schema.simpleString()[7:-1] + ",record:boolean,owner:bigint"), "candidates")
    out = marked.filter("record")
    #: Only records that hold the magic are put together, from a second read of their pieces.
    broken = out.filter("digest is null and kind = 'response'").select("file", F.col("at").alias("owner"))
    inside = marked.join(broken, ["file", "owner"]).select("file", "at", "owner")
    if inside.limit(1).count():
        texts = pieces(spark, path, text=True).select("file", "at", "head", "length", "text").join(inside, ["file", "at"])
        whole = texts.groupBy("file", "owner").applyInPandas(glued, "file string, at long, glued string")
        out = out.join(whole, ["file", "at"], "left").withColumn("digest", F.coalesce("digest", "glued"))
    revisit = F.col("kind") == "revisit"
    return out.select(
        F.col("page_id").try_cast("long").alias("page_id"), F.col("kind").alias("record_type"),
        F.when(revisit, F.col("told_bytes").try_cast("long")).otherwise(F.col("length")).cast("long").alias("payload_bytes"),
        F.when(revisit, F.col("told_digest")).otherwise(F.col("digest")).alias("payload_digest"),
        F.col("refers_to").try_cast("long").alias("refers_to"), (revisit | (F.col("digest") == F.col("told_digest"))).alias("intact"),
    )


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "warc")
    write_warc(table(spark, sf_dir, "pages"), path)
    return read_warc(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact")


SQL = f"""
with p as (select page_id, strlen(coalesce(html, '')) n, sha256(coalesce(html, '')) d from pages),
f as (select d, min(page_id) first from p where n >= {REVISIT_BYTES} group by d)
select page_id, n::bigint payload_bytes, p.d payload_digest, case when first < page_id then 'revisit' else 'response' end record_type,
  case when first < page_id then first end refers_to, true intact
from p left join f on f.d = p.d and n >= {REVISIT_BYTES}"""
