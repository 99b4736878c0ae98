"""State as checksummed tables: a bundle is a folder with rows and a manifest.

A write goes to a folder named by its revision, and readers take one whose manifest is there and whose checksum holds. A writer first claims its
revision by a file that the store creates only once, so that of two writers of one revision one fails before it writes, and a writer whose
revision isn't the one after the newest is stale.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def checksum(rows: DataFrame) -> tuple[int, str]:
    """(number of rows, order-free sum of row hashes)."""
    row = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64(F.to_json(F.struct(*sorted(rows.columns)))).cast("decimal(38,0)")), F.lit(0)).cast("string").alias("s")).first()
    return row.n, row.s


class StaleRevision(ValueError):
    """Another writer has the revision, or a newer one."""


def _files(spark: SparkSession, path: str):  # noqa: ANN202
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def newest_revision(spark: SparkSession, path: str) -> int:
    """The newest revision whose manifest is written, or 0."""
    at, files = _files(spark, path)
    if not files.exists(at):
        return 0
    names = [x.getPath().getName() for x in files.listStatus(at)]
    revisions = sorted((int(n.removeprefix("revision=")) for n in names if n.startswith("revision=")), reverse=True)
    return next((r for r in revisions if files.exists(_files(spark, f"{path}/revision={r:09d}/manifest/_SUCCESS")[0])), 0)


def swap_bundle(rows: DataFrame, path: str, owner: str, expected: int) -> int:
    """Writes the revision after `expected` and returns it; fails with StaleRevision if `expected` isn't the newest, or another writer has claimed the one after it.

    A writer that dies after its claim leaves a revision without manifest: abandon() gives it free.
    """
    spark, revision = rows.sparkSession, expected + 1
    newest = newest_revision(spark, path)
    if newest != expected:
        raise StaleRevision(f"the newest revision is {newest}, not {expected}")
    claim, files = _files(spark, f"{path}/claims/{revision:09d}")
    files.mkdirs(claim.getParent())
    try:
        files.create(claim, False).close()  # made only if it isn't there
    except Exception as there:
        raise StaleRevision(f"revision {revision} has another writer") from there
    write_bundle(rows, path, owner, revision)
    return revision


def abandon(spark: SparkSession, path: str, revision: int) -> None:
    """Gives a revision free whose writer died: its claim and what it wrote go. A revision with a manifest stays."""
    if newest_revision(spark, path) < revision:
        for part in (f"{path}/revision={revision:09d}", f"{path}/claims/{revision:09d}"):
            at, files = _files(spark, part)
            files.delete(at, True)


def write_bundle(rows: DataFrame, path: str, owner: str, revision: int) -> None:
    spark = rows.sparkSession
    at = f"{path}/revision={revision:09d}"
    rows.write.parquet(f"{at}/rows")
    n, total = checksum(spark.read.parquet(f"{at}/rows"))
    spark.createDataFrame([(owner, revision, n, total)], "owner string, revision long, n long, checksum string").coalesce(1).write.parquet(f"{at}/manifest")


def read_bundle(spark: SparkSession, path: str, owner: str, revision: int) -> DataFrame:
    """The rows of a revision; fails for another owner or damaged rows."""
    at = f"{path}/revision={revision:09d}"
    rows, manifest = spark.read.parquet(f"{at}/rows"), spark.read.parquet(f"{at}/manifest").first()
    if manifest.owner != owner:
        raise ValueError(f"the bundle belongs to {manifest.owner}")
    if checksum(rows) != (manifest.n, manifest.checksum):
        raise ValueError("the bundle's rows don't have its checksum")
    return rows
