"""Files: a store's populations as Parquet snapshots, atomic text files, mailboxes."""

from __future__ import annotations

import html
import json
import mailbox
import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from email.utils import getaddresses

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..plans.recipe import Relation
from ..store import FactStore


class Warehouse:
    """Snapshots of a store in a folder all executors share: each a folder of its own, made current by one small file.

    Readers see the last whole snapshot or the one before, never a part. The pointer is written through Spark, so the
    folder may be on any file system that Spark knows.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def install(self, store: FactStore, names: list[str] | None = None) -> str:
        """Write the populations and make them current; the snapshot's name."""
        name = uuid.uuid4().hex
        held = {}
        for n in names or store.names():
            r = store.relation(n).as_set()
            r.df.write.parquet(f"{self.folder}/{name}/{n}")
            held[n] = sorted(sorted(k) for k in r.keys)
        version = self.version() + 1
        text = json.dumps({"version": version, "snapshot": name, "facts": held})
        self.spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(f"{self.folder}/current-{version:09d}")
        return name

    def _pointers(self) -> list[dict]:
        fs, path = self._fs(self.folder)
        if not fs.exists(path):
            return []
        found = sorted(s.getPath().getName() for s in fs.listStatus(path) if s.getPath().getName().startswith("current-"))
        out = []
        for f in found:
            rows = self.spark.read.text(f"{self.folder}/{f}").collect()
            if rows:
                out.append(json.loads(rows[0].value))
        return out

    def _fs(self, folder: str):
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(folder)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def version(self) -> int:
        found = self._pointers()
        return found[-1]["version"] if found else 0

    def open(self, schema=None, version: int | None = None) -> FactStore:
        """The current snapshot, or that of a version."""
        found = [p for p in self._pointers() if version is None or p["version"] == version]
        if not found:
            raise FileNotFoundError(f"no snapshot in {self.folder}")
        p = found[-1]

        def load(n: str, keys):
            return lambda: Relation(self.spark.read.parquet(f"{self.folder}/{p['snapshot']}/{n}"), frozenset(frozenset(k) for k in keys))

        return FactStore(self.spark, {n: load(n, keys) for n, keys in p["facts"].items()}, schema)


def write_atomically(path: str, text: str) -> None:
    """A driver-side file, replaced as a whole."""
    folder = os.path.dirname(os.path.abspath(path))
    with tempfile.NamedTemporaryFile("w", dir=folder, delete=False) as f:
        f.write(text)
    os.replace(f.name, path)


def own_text(body: str) -> str:
    """A message's own lines: without quoted ones, what introduces them, and the signature."""
    out = []
    for line in body.replace("\r\n", "\n").split("\n"):
        if line.rstrip() == "--":
            break
        if line.startswith(">") or re.match(r"On .+ wrote:\s*$", line):
            continue
        out.append(line)
    return "\n".join(out).strip()


def _body(message) -> str:
    """The first plain text part, else the text of the first HTML part."""
    found: dict[str, str] = {}
    for p in message.walk():
        data = None if p.is_multipart() else p.get_payload(decode=True)
        if data is not None:
            try:
                found.setdefault(p.get_content_type(), data.decode(p.get_content_charset() or "utf-8", "replace"))
            except LookupError:  # an unknown character set
                found.setdefault(p.get_content_type(), data.decode("utf-8", "replace"))
    if "text/plain" in found:
        return found["text/plain"]
    without = re.sub(r"(?is)<(script|style)\b.*?</\1>|<[^>]*>", " ", found.get("text/html", ""))
    return re.sub(r"[ \t]+", " ", html.unescape(without)).strip()


def _deleted(message) -> bool:
    """Whether the mail program has marked the message as deleted (fixed value: bit 8 of its hexadecimal status)."""
    try:
        return bool(int(message.get("X-Mozilla-Status", "0"), 16) & 8)
    except ValueError:
        return False


class MboxReader(DataSourceReader):
    def __init__(self, path: str, wanted: dict[str, str]):
        self.path, self.wanted = path, wanted

    def partitions(self) -> list[InputPartition]:
        if os.path.isdir(self.path):
            return [InputPartition(os.path.join(self.path, f)) for f in sorted(os.listdir(self.path))]
        return [InputPartition(self.path)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        box = mailbox.mbox(partition.value, create=False)
        for k, m in enumerate(box):
            if not (m.get("Message-ID") or "").strip(" <>\t") or _deleted(m):
                continue
            senders = [a for _, a in getaddresses([str(x) for x in m.get_all("From", [])])]
            to = [(kind.lower(), a) for kind in ("To", "Cc") for _, a in getaddresses([str(x) for x in m.get_all(kind, [])]) if a]
            asked = {"sender": senders, "recipient": [a for _, a in to], "id": [m.get("Message-ID").strip(" <>\t")]}
            if any(v not in asked[c] for c, v in self.wanted.items()):
                continue
            text = _body(m)
            yield (partition.value, k, m.get("Message-ID"), m.get("In-Reply-To"), m.get("From"), m.get("To"), m.get("Subject"), m.get("Date"), text, own_text(text), to)


class MboxSource(DataSource):
    """spark.read.format("mbox").load(path): a mailbox, or a folder of them (one partition each), on a mounted path. Deleted
    messages and those without an id are left out; the options sender, recipient (to or copy) and id ask for an address or
    a message."""

    @classmethod
    def name(cls) -> str:
        return "mbox"

    def schema(self) -> str:
        return "file string, place int, message_id string, in_reply_to string, sender string, recipient string, subject string, date string, text string, own_text string, recipients array<struct<kind: string, address: string>>"

    def reader(self, schema) -> MboxReader:
        return MboxReader(self.options["path"], {c: self.options[c] for c in ("sender", "recipient", "id") if c in self.options})


def mailboxes(spark: SparkSession, path: str, **wanted: str) -> DataFrame:
    spark.dataSource.register(MboxSource)
    return spark.read.format("mbox").options(**wanted).load(path)
