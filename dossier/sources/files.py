"""Case bundles and evidence files: scan, decode, call-record tables, import outcomes, integrity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "case_id string, title string, state string, district string, station string, fir_no string, date_registered date, description string"
#: Column names that mean a tower or a date, whatever their case (fixed values); `tower_location` is what bundles use.
TOWERS = ("tower", "tower_id", "cell", "cell_id", "cell_tower", "site", "site_id", "tower_location")
DATES = ("date", "call_date", "datetime", "timestamp", "day")


def manifests(spark: SparkSession, root: str) -> DataFrame:
    """One row a case folder's manifest.json, with the folder."""
    raw = spark.read.option("multiLine", True).schema(MANIFEST).json(f"{root}/*/manifest.json")
    return raw.withColumn("folder", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2))


def bundle_files(spark: SparkSession, root: str) -> DataFrame:
    """folder, file_name, path, size, content of all files but manifests."""
    f = spark.read.format("binaryFile").load(f"{root}/*/*")
    parts = F.split("path", "/")
    named = f.select(F.element_at(parts, -2).alias("folder"), F.element_at(parts, -1).alias("file_name"), "path", F.col("length").alias("size"), "content")
    return named.filter("file_name <> 'manifest.json'")


def ingest(files: DataFrame) -> DataFrame:
    """files with sha256, a safe name, and ok: empty files are rejected."""
    safe = F.translate("file_name", "/\\", "__")
    return files.withColumns({"sha256": F.sha2("content", 256), "safe_name": safe, "ok": F.octet_length("content") > 0})


def import_outcome(cases: DataFrame, files: DataFrame, known: DataFrame, listed: DataFrame | None = None) -> DataFrame:
    """folder, fir_no, outcome, good, bad: a missing or known number is rejected, else success, partial or failed by its files.

    listed: folder, file_name that should be there; those that the scan did not give (it passes over empty files) are bad.
    """
    got = ingest(files).select("folder", "file_name", "ok")
    if listed is not None:
        got = got.unionByName(listed.join(got, ["folder", "file_name"], "left_anti").select("folder", "file_name", F.lit(False).alias("ok")))
    n = got.groupBy("folder").agg(F.count_if("ok").alias("good"), F.count_if(~F.col("ok")).alias("bad"))
    rows = cases.join(n, "folder", "left").fillna(0, ["good", "bad"]).join(known.select("fir_no", F.lit(True).alias("known")), "fir_no", "left")
    missing = F.coalesce(F.btrim("fir_no"), F.lit("")) == ""
    outcome = F.when(missing, "rejected: no number").when(F.col("known"), "rejected: known number").when(F.col("good") == 0, "failed").when(F.col("bad") > 0, "partial").otherwise("success")
    return rows.select("folder", "fir_no", outcome.alias("outcome"), "good", "bad")


def decoded(content: Column) -> Column:
    """Text of bytes: UTF-8 if well formed, else UTF-16 if that is plausible, else Latin-1."""
    utf8 = content.cast("string")
    n = F.octet_length(content)
    hexed = F.hex(content)
    pairs = F.regexp_extract_all(hexed, F.lit("[0-9A-F]{4}"), F.lit(0))
    mark = F.left(hexed, F.lit(4)).isin("FFFE", "FEFF")
    #: Without a byte-order mark big-endian is assumed; surrogates must come in pairs.
    kinds = F.array_join(F.transform(pairs, lambda p: F.when(p.rlike("^D[89AB]"), "h").when(p.rlike("^D[C-F]"), "l").otherwise(".")), "")
    formed = (n % 2 == 0) & (n > 0) & (mark | ~F.regexp_replace(kinds, "hl", "").rlike("[hl]"))
    return F.when(F.is_valid_utf8(utf8), utf8).when(formed, F.decode(content, "UTF-16")).otherwise(F.decode(content, "ISO-8859-1"))


def sample(content: Column, text_like: Column) -> Column:
    """The head that a classifier sees: 4000 characters of text files, else 512 bytes."""
    head = decoded(whole_characters(content, 200_000))
    return F.when(text_like, F.left(head, F.lit(4000))).otherwise(F.left(decoded(whole_characters(content, 512)), F.lit(512)))


def whole_characters(content: Column, size: int) -> Column:
    """The first `size` bytes, less a UTF-8 character that they cut."""
    heads = [F.substring(content, F.lit(1), F.lit(size - k)) for k in range(4)]
    return F.coalesce(*[F.when(F.is_valid_utf8(h.cast("string")), h) for h in heads], heads[0])


def text_status(mime: Column, name: Column, content: Column) -> Column:
    """done, skipped (empty), or unavailable (needs an engine that is not here)."""
    plain = mime.startswith("text/") | F.lower(name).rlike(r"\.(txt|csv)$")
    return F.when(F.octet_length(content) == 0, "skipped").when(plain, "done").otherwise("unavailable")


def text_result(mime: Column, name: Column, content: Column) -> Column:
    """struct<status, engine, pages, confidence, text>: what reading a file gave; bytes that are missing have failed."""
    status = F.when(content.isNull(), "failed").otherwise(text_status(F.coalesce(mime, F.lit("")), F.coalesce(name, F.lit("")), content))
    done = status == "done"
    return F.struct(
        status.alias("status"), F.when(done, "raw").alias("engine"), F.when(done, 1).alias("pages"), F.when(done, 1.0).alias("confidence"), F.when(done, decoded(content)).alias("text"),
    )


def cdr_rows(evidence: DataFrame) -> DataFrame:
    """evidence_id, line, tower, date of delimited call records: the header names the columns; rows without a tower go."""
    lines = F.filter(F.split(F.coalesce("text", F.lit("")), r"\r?\n"), lambda x: F.btrim(x) != "")
    cells = lambda row: F.transform(F.split(row, ",", -1), lambda c: F.btrim(F.btrim(c), F.lit('"')))
    rows = evidence.select("evidence_id", lines.alias("lines")).withColumn("head", F.transform(cells(F.get("lines", F.lit(0))), lambda c: F.lower(c)))
    place = lambda names: F.array_position(F.transform("head", lambda h: h.isin(*names)), True)
    rows = rows.withColumns({"t": place(TOWERS), "d": place(DATES)}).filter("t > 0")
    each = rows.select("evidence_id", "t", "d", F.posexplode(F.slice("lines", F.lit(2), F.size("lines"))).alias("line", "row")).withColumn("c", cells(F.col("row")))
    tower = F.get("c", (F.col("t") - 1).cast("int"))
    day = F.when(F.col("d") > 0, F.try_to_date(F.left(F.get("c", (F.col("d") - 1).cast("int")), F.lit(10)), "yyyy-MM-dd"))
    return each.select("evidence_id", "line", tower.alias("tower"), day.alias("date")).filter("coalesce(tower, '') <> ''")


def log_custody(log: DataFrame, evidence: DataFrame, action: str, actor: str, ts: str) -> DataFrame:
    """The ledger with an entry for each evidence row (evidence_id, file_name, sha256): name and digest are kept as they are now."""
    entry = evidence.select("evidence_id", F.lit(actor).alias("actor"), F.lit(action).alias("action"), F.lit(ts).cast("timestamp").alias("ts"), "file_name", "sha256")
    return log.unionByName(entry)


def custody(log: DataFrame, evidence: DataFrame) -> DataFrame:
    """The ledger (evidence_id, actor, action, ts, file_name, sha256) in order, with whether its file still exists: entries outlive files."""
    return log.join(evidence.select("evidence_id", F.lit(True).alias("_there")), "evidence_id", "left").withColumn("exists", F.coalesce("_there", F.lit(False))).drop("_there")


def integrity(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """evidence_id, intact: whether re-read bytes (path, content) still have the digest of the manifest (evidence_id, path, sha256)."""
    return manifest.join(files.select("path", F.sha2("content", 256).alias("now")), "path", "left").select("evidence_id", F.col("sha256").eqNullSafe(F.col("now")).alias("intact"))
