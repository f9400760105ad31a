"""Change feeds as Python data sources: a paged delta feed, an accounting sweep and its change sweep.

Pages come from a `pages` option, a folder of JSON files; a live connector overrides `fetch`.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition, SimpleDataSourceStreamReader

ITEM = "drive string, id string, name string, mtime string, deleted boolean, etag string"
PAGE_ROWS = 1000


def read_page(folder: str, name: str) -> dict | None:
    path = os.path.join(folder, f"{name}.json")
    if not os.path.exists(path):
        return None
    with open(path, encoding="utf-8") as f:
        return json.load(f)


class DeltaReader(SimpleDataSourceStreamReader):
    """Walks next links of each drive to its delta link. The offset is the delta link per drive. A page with status 410 means the link has
    expired: the drive is read again from the start. A drive that vanishes deletes nothing."""

    def __init__(self, folder: str):
        self.folder = folder

    def initialOffset(self) -> dict:
        return {}

    def fetch(self, drive: str, link: str) -> dict | None:
        return read_page(self.folder, f"{drive}-{link}")

    def drives(self) -> list[str]:
        return sorted({x.partition("-")[0] for x in os.listdir(self.folder) if x.endswith(".json")})

    def sweep(self, start: dict) -> tuple[list[tuple], dict]:
        rows, end = [], dict(start)
        for drive in self.drives():
            link = start.get(drive, "start")
            page = self.fetch(drive, link)
            if page is not None and page.get("status") == 410:
                page = self.fetch(drive, "start")
            while page is not None:
                rows += [(drive, x["id"], x.get("name"), x.get("mtime"), "@removed" in x, x.get("etag")) for x in page.get("value", [])]
                if "nextLink" in page:
                    page = self.fetch(drive, page["nextLink"])
                else:
                    end[drive] = page.get("deltaLink", link)
                    page = None
        return rows, end

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows, end = self.sweep(start)
        return iter(rows), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter(self.sweep(start)[0])


class DeltaFeed(DataSource):
    @classmethod
    def name(cls) -> str:
        return "delta_feed"

    def schema(self) -> str:
        return ITEM

    def simpleStreamReader(self, schema: object) -> DeltaReader:
        return DeltaReader(self.options["pages"])


class DriveSweep(InputPartition):
    def __init__(self, drive: str, sweep: int):
        self.drive, self.sweep = drive, sweep


class DrivesReader(DataSourceStreamReader):
    """A delta feed read by one task for each drive. The offset is the number of a sweep.

    The task that reads a drive's sweep walks from the link that the sweep before left to the new delta link and leaves that for the next sweep, in a folder that all machines share,
    under the drive's and the sweep's number; so nothing but a sweep's number and the drives' names pass through the driver, and a sweep that is read again begins at the same link. An
    expired link (status 410) starts its drive anew. A sweep is planned if some drive has a page at its link.
    """

    def __init__(self, options: dict):
        self.folder, self.links = options["pages"], options["links"]
        os.makedirs(self.links, exist_ok=True)

    def fetch(self, drive: str, link: str) -> dict | None:
        return read_page(self.folder, f"{drive}-{link}")

    def drives(self) -> list[str]:
        return sorted({x.partition("-")[0] for x in os.listdir(self.folder) if x.endswith(".json")})

    def noted(self, name: str) -> str | None:
        path = os.path.join(self.links, name)
        if not os.path.exists(path):
            return None
        with open(path, encoding="utf-8") as f:
            return f.read()

    def note(self, name: str, text: str) -> None:
        path = os.path.join(self.links, name)
        with open(f"{path}.{os.getpid()}.new", "w", encoding="utf-8") as f:
            f.write(text)
        os.replace(f.name, path)

    def link(self, drive: str, sweep: int) -> str:
        """Where a drive's sweep begins: the link that the last sweep before it left."""
        return next((found for k in range(sweep, 0, -1) if (found := self.noted(f"{drive}-{k}")) is not None), "start")

    def initialOffset(self) -> dict:  # noqa: N802
        return {"sweep": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        done = max((int(x.rpartition("-")[2]) for x in os.listdir(self.links) if x.rpartition("-")[2].isdigit()), default=0)
        more = any(self.fetch(d, self.link(d, done)) is not None for d in self.drives())
        return {"sweep": done + more}

    def partitions(self, start: dict, end: dict) -> list[DriveSweep]:
        return [DriveSweep(d, k) for k in range(start["sweep"], end["sweep"]) for d in self.drives()]

    def read(self, partition: DriveSweep) -> Iterator[tuple]:
        drive, at = partition.drive, self.link(partition.drive, partition.sweep)
        page = self.fetch(drive, at)
        if page is not None and page.get("status") == 410:
            page = self.fetch(drive, "start")
        while page is not None:
            for x in page.get("value", []):
                yield drive, x["id"], x.get("name"), x.get("mtime"), "@removed" in x, x.get("etag")
            if "nextLink" in page:
                page = self.fetch(drive, page["nextLink"])
            else:
                self.note(f"{drive}-{partition.sweep + 1}", page.get("deltaLink", at))
                page = None


class DrivesFeed(DataSource):
    """Options: pages, links (a folder that driver and executors share)."""

    @classmethod
    def name(cls) -> str:
        return "drives_feed"

    def schema(self) -> str:
        return ITEM

    def streamReader(self, schema: object) -> DrivesReader:  # noqa: N802
        return DrivesReader(self.options)


class Page(InputPartition):
    def __init__(self, entity: str, start: int):
        self.entity, self.start = entity, start


class SweepReader(DataSourceReader):
    """One partition per entity; each pages from position 1 until a page is short."""

    def __init__(self, folder: str, entities: list[str], size: int):
        self.folder, self.entities, self.size = folder, entities, size

    def partitions(self) -> list[Page]:
        return [Page(e, 1) for e in self.entities]

    def fetch(self, entity: str, start: int) -> list[dict]:
        return (read_page(self.folder, f"{entity}-{start}") or {}).get("rows", [])

    def read(self, partition: Page) -> Iterator[tuple]:
        start = partition.start
        while True:
            rows = self.fetch(partition.entity, start)
            for r in rows:
                yield partition.entity, str(r.get("Id")), r.get("status"), json.dumps(r, sort_keys=True, separators=(",", ":"))
            if len(rows) < self.size:
                return
            start += self.size


class AccountingSweep(DataSource):
    """Options: pages, entities (comma-separated), page_rows."""

    @classmethod
    def name(cls) -> str:
        return "accounting_sweep"

    def schema(self) -> str:
        return "entity string, id string, status string, body string"

    def reader(self, schema: object) -> SweepReader:
        return SweepReader(self.options["pages"], self.options["entities"].split(","), int(self.options.get("page_rows", PAGE_ROWS)))


def change_sweep(changes: DataFrame, last_swept: Column, as_of: Column, lookback_days: int = 30, safety_days: int = 1) -> DataFrame:
    """Changes with whether the whole entity must be read again: the last sweep is out of the feed's reach, or a page was full."""
    too_old = last_swept < F.date_sub(as_of, lookback_days - safety_days)
    return changes.withColumn("resync", F.coalesce(too_old, F.lit(True)) | (F.col("page_rows") >= PAGE_ROWS))


def change_items(rows: DataFrame) -> DataFrame:
    """Swept rows as items: tombstone for deleted ones, else upsert with canonical bytes' hash."""
    deleted = F.col("status") == "Deleted"
    return rows.select(
        F.concat_ws("/", "entity", "id").alias("native_id"),
        F.when(deleted, "tombstone").otherwise("upsert").alias("action"),
        F.when(~F.coalesce(deleted, F.lit(False)), F.sha2(F.col("body").cast("binary"), 256)).alias("content_hash"),
    )


PERMISSIONS = "array<struct<id:string, roles:array<string>, link:struct<scope:string, expires:string>, inherited:boolean, user:string, group:string>>"
# Rights by provider role.
RIGHTS = {"read": "read", "write": "write", "owner": "write", "sp.full control": "write"}


def permission_grants(rows: DataFrame) -> DataFrame:
    """rows: id, permissions (JSON). Grants: id, principal, right, via (link, inherited or direct), expires. Groups are named by reference."""
    p = rows.select("id", F.explode(F.from_json("permissions", PERMISSIONS)).alias("p")).select("id", *[F.col(f"p.{c}").alias(c) for c in ("roles", "link", "inherited", "user", "group")])
    flat = p.select("*", F.explode("roles").alias("role"))
    right = F.try_element_at(F.create_map(*[F.lit(x) for kv in RIGHTS.items() for x in kv]), F.lower("role"))
    principal = F.when(F.col("link").isNotNull(), F.concat(F.lit("link:"), F.col("link.scope"))).when(F.col("group").isNotNull(), F.concat(F.lit("group:"), F.col("group"))).otherwise(F.concat(F.lit("user:"), F.col("user")))
    via = F.when(F.col("link").isNotNull(), "link").when(F.coalesce("inherited", F.lit(False)), "inherited").otherwise("direct")
    return flat.select(rows.columns[0], principal.alias("principal"), right.alias("right"), via.alias("via"), F.col("link.expires").alias("expires")).filter("right IS NOT NULL AND principal IS NOT NULL").distinct()
