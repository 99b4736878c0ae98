"""WARC: a content-addressed archive.

Payload bytes are stored once for each SHA-256 digest, in one table; the exact header of every record in another. Joins on the
digest give the records back, and each payload that is read is held against its digest.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import cut, scratch, table

#: Payloads of fewer bytes are never revisits.
LEAST_BYTES = 100
CRLF = "\r\n"


@dataclass(frozen=True)
class Archive:
    """Paths of the two tables: payloads (digest, payload) and headers (id, digest, header)."""

    payloads: str
    headers: str


def _header(kind: Column, id_: Column, first: Column, url: Column, digest: Column, n: Column) -> Column:
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), kind),
        F.concat(F.lit("WARC-Record-ID: <urn:page:"), F.coalesce(id_.cast("string"), F.lit("")), F.lit(">")),
        # A line break would end the field.
        F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace(F.coalesce(url, F.lit("")), r"[\r\n]+", " ")),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), digest),
        F.when(kind == "revisit", F.concat(F.lit("WARC-Refers-To: <urn:page:"), first.cast("string"), F.lit(">"))),
        F.when(kind == "revisit", F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.concat(F.lit("Content-Length: "), F.when(kind == "revisit", F.lit(0)).otherwise(n)),
    ]
    return F.concat(F.concat_ws(CRLF, *lines), F.lit(CRLF + CRLF))


def write_archive(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = LEAST_BYTES, at: str | None = None) -> Archive:
    """Writes a record for each row; null payloads are empty.

    Of records with equal payloads of at least least_bytes, those with the smallest id are responses and the others
    revisits of it; shorter ones are responses. Rows of null ids are responses, and no others refer to them. Repeated rows are
    records of their own; of equal smallest ids all are responses. Ids are integers (others become null). Other columns are left out, so
    that no name clashes; a payload of any length is one row, an empty table an empty archive.
    """
    spark = pages.sparkSession
    at = at or scratch(spark, "warc")
    archive = Archive(f"{at}/payloads", f"{at}/headers")
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).try_cast("long").alias("id"), F.col(url_col).alias("url"), payload.alias("payload"), F.sha2(payload, 256).alias("digest"))
    # Each task sends one payload for each digest it has.
    rows.groupBy("digest").agg(F.first("payload").alias("payload")).write.parquet(archive.payloads)
    heads = rows.select("id", "url", "digest", F.octet_length("payload").alias("n"))
    # Only payloads of several records; kept, so that the join gets them by an exchange of its own and can split a popular digest.
    firsts = cut(heads.filter(F.col("n") >= least_bytes).groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("records")).filter("records > 1").select("digest", "first"))
    both = heads.join(firsts, "digest", "left")
    kind = F.when(F.col("id") > F.col("first"), F.lit("revisit")).otherwise(F.lit("response"))
    both.select("id", "digest", _header(kind, F.col("id"), F.col("first"), F.col("url"), F.col("digest"), F.col("n")).alias("header")).write.parquet(archive.headers)
    return archive


def read_archive(spark: SparkSession, archive: Archive) -> DataFrame:
    """(id, header, payload, record): payload is the full one also of revisits, record the bytes of the WARC record itself.

    Fails if stored bytes don't have their digest.
    """
    payloads = spark.read.schema("digest string, payload binary").parquet(archive.payloads)
    headers = spark.read.schema("id long, digest string, header string").parquet(archive.headers)
    found = F.sha2("payload", 256)
    checked = payloads.select("digest", F.when(found == F.col("digest"), F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("payload damaged: "), F.col("digest"))).cast("binary")).alias("payload"))
    block = F.when(field(F.col("header"), "WARC-Type") == "revisit", F.lit(b"")).otherwise(F.col("payload"))
    return headers.join(checked, "digest").select("id", "header", "payload", F.concat(F.col("header").cast("binary"), block, F.lit((CRLF * 2).encode())).alias("record"))


def field(header: Column, name: str) -> Column:
    """A field's value, or null."""
    return F.nullif(F.regexp_extract(header, rf"(?m)^{name}: ([^\r\n]*)", 1), F.lit(""))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = read_archive(spark, write_archive(table(spark, sf_dir, "pages")))
    header, number = F.col("header"), r"<urn:page:(-?\d+)>"
    return records.select(
        F.regexp_extract(field(header, "WARC-Record-ID"), number, 1).try_cast("long").alias("page_id"), F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"),
        field(header, "WARC-Type").alias("record_type"), F.regexp_extract(field(header, "WARC-Refers-To"), number, 1).try_cast("long").alias("refers_to"),
    )


ORACLE = """
with p as (select page_id, octet_length(encode(coalesce(html, ''))) as n, sha256(coalesce(html, '')) as d from pages),
f as (select d, min(page_id) as first from p where n >= 100 group by d)
select p.page_id, cast(n as bigint) as payload_bytes, p.d as payload_digest,
  case when p.page_id > f.first then 'revisit' else 'response' end as record_type,
  case when p.page_id > f.first then f.first end as refers_to
from p left join f on p.d = f.d
"""
