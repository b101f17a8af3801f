"""Writing results: keyed overwrites, idempotent deliveries, backups, pages."""

from __future__ import annotations

import html
import json
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PAGE_ROWS = 10_000  # a page is put together by the driver


def append_new(rows: DataFrame, path: str, keys: list[str]) -> int:
    """Append the rows whose key is not in the table at ``path`` yet, one of each key; the number of rows added.

    A repeated call adds nothing, so a retried run is harmless.
    """
    spark = rows.sparkSession
    fresh = rows.dropDuplicates(keys)
    if _exists(spark, path):
        fresh = fresh.join(spark.read.parquet(path).select(*keys), keys, "left_anti")
    fresh = fresh.persist()
    try:
        added = fresh.count()
        if added:
            fresh.write.mode("append").parquet(path)
        return added
    finally:
        fresh.unpersist()


def overwrite_partition(rows: DataFrame, path: str, *columns: str) -> None:
    """Replace just the partitions that occur in the rows."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*columns).parquet(path)


def backup(tables: dict[str, DataFrame], path: str, stamp: str) -> DataFrame:
    """Every table as JSON lines below ``path/stamp``, and a manifest of row counts, which is returned."""
    for name, df in tables.items():
        df.write.mode("overwrite").json(f"{path}/{stamp}/{name}")
    spark = next(iter(tables.values())).sparkSession
    counts = [(name, spark.read.schema(df.schema).json(f"{path}/{stamp}/{name}").count()) for name, df in tables.items()]
    manifest = spark.createDataFrame(counts, "name string, n long")
    manifest.coalesce(1).write.mode("overwrite").json(f"{path}/{stamp}/manifest")
    return manifest


def prune_backups(spark, path: str, keep: int = 10) -> list[str]:
    """Remove all but the newest backups; the names removed."""
    fs, root = _fs(spark, path)
    names = sorted((s.getPath().getName() for s in fs.listStatus(root) if s.isDirectory()), reverse=True) if fs.exists(root) else []
    for name in names[keep:]:
        fs.delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}"), True)
    return names[keep:]


def digest_pages(rows: DataFrame, title: str, tier: str = "tier", text: str = "title", link: str = "url", size: int = PAGE_ROWS) -> Iterator[str]:
    """HTML pages of at most ``size`` rows each under headings per tier, whose counts are of all rows; text is escaped.

    No row is left out; the driver holds one page at a time.  Without rows there is one page.
    """
    named = F.coalesce(tier, F.lit("")).alias("tier_")
    counts = dict(rows.groupBy(named).count().collect())  # a row per tier
    given = rows.select(named, F.col(text).alias("text_"), F.col(link).alias("link_")).orderBy("tier_", "text_", "link_").toLocalIterator(prefetchPartitions=True)

    def page(part: list) -> str:
        lines, head = [f"<html><body><h1>{html.escape(title)}</h1>"], None
        for name, shown, address in part:
            if name != head:
                lines += ["</ul>"] * (head is not None) + [f"<h2>{html.escape(name)} ({counts[name]})</h2><ul>"]
                head = name
            lines.append(f'<li><a href="{html.escape(address or "", quote=True)}">{html.escape(shown or "")}</a></li>')
        return "\n".join([*lines, *["</ul>"] * (head is not None), "</body></html>"])

    part: list = []
    for row in given:
        part.append(row)
        if len(part) == size:
            yield page(part)
            part = []
    if part or not counts:
        yield page(part)


def digest_page(rows: DataFrame, title: str, tier: str = "tier", text: str = "title", link: str = "url") -> str:
    """All pages of ``digest_pages`` in one text."""
    return "\n".join(digest_pages(rows, title, tier, text, link))


def deliver(messages: DataFrame, path: str, send, dry_run: bool = True) -> int:
    """Hand the messages not yet delivered to ``send`` (an iterator of rows, per partition), then record them; a dry run does neither.

    Messages have user_id and alert_id.  Records are written only after the
    sending job ended well.
    """
    spark = messages.sparkSession
    new = messages.dropDuplicates(["user_id", "alert_id"])
    if _exists(spark, path):
        new = new.join(spark.read.parquet(path).select("user_id", "alert_id"), ["user_id", "alert_id"], "left_anti")
    if dry_run:
        return new.count()
    new.foreachPartition(send)
    return append_new(new.select("user_id", "alert_id"), path, ["user_id", "alert_id"])


def report(row: DataFrame) -> str:
    """A one-row frame as a JSON text."""
    return json.dumps(json.loads(row.select(F.to_json(F.struct("*"))).first()[0]), sort_keys=True)


def _fs(spark, path: str):
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), root


def _exists(spark, path: str) -> bool:
    fs, root = _fs(spark, path)
    return fs.exists(root) and any(s.getPath().getName().endswith(".parquet") for s in fs.listStatus(root))
