"""The library as Parquet folders below one path; a record of each commit names the folders that make up the tables.

Appends write one folder of new rows, and what is written together becomes visible together. Deletes and tables of many
small folders are rewritten. Plain Parquet needs no catalog for this; `vacuum` removes folders that nothing names any more.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMAS = {
    "documents": "doc_id long, name string, sha256 string, pages int, n_chunks int, summary string, summary_mode string, keywords array<string>, created timestamp",
    "chunks": "doc_id long, idx int, page int, text string, doc_name string",
    "messages": "id long, scope string, role string, content string, meta string, created timestamp",
}
#: The column of each table whose highest value ever written is kept in the records.
IDS = {"documents": "doc_id", "messages": "id"}
#: Folders of a table beyond which an append writes the table anew, as one.
MOST_FOLDERS = 64


class Store:
    """Reads and writes the tables; one writer at a time."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def read(self, table: str) -> DataFrame:
        return self._rows(table, self._record()["tables"].get(table, []))

    def next_id(self, table: str) -> int:
        """An id above all that the table holds or has held."""
        return self._record()["last"].get(table, 0) + 1

    def append(self, **rows: DataFrame) -> None:
        """Adds rows to the tables named; all of them become visible at once."""
        self._commit(rows, {})

    def replace(self, **rows: DataFrame) -> None:
        """Puts rows in place of the tables named; all of them become visible at once."""
        self._commit({}, rows)

    def delete_document(self, doc_id: int) -> bool:
        """Deletes a document, its chunks and the messages of its own scope; tells whether it was there."""
        documents = self.read("documents")
        if documents.where(F.col("doc_id") == doc_id).isEmpty():
            return False
        left = {table: self.read(table).where(F.col("doc_id") != doc_id) for table in ("documents", "chunks")}
        self.replace(messages=self.read("messages").where(F.col("scope") != str(doc_id)), **left)
        return True

    def vacuum(self) -> None:
        """Removes folders and records that the last commit doesn't need; frames read before it may lose their files."""
        record, last = self._record(), self._commits()[-1:]
        named = {folder for folders in record["tables"].values() for folder in folders}
        for table in SCHEMAS:
            for status in self._list(table):
                if f"{table}/{status.getPath().getName()}" not in named:
                    self._fs().delete(status.getPath(), True)
        for name in self._commits():
            if name not in last and name != record["name"]:
                self._fs().delete(self._at(f"commits/{name}"), False)

    def _rows(self, table: str, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], SCHEMAS[table])
        return self.spark.read.schema(SCHEMAS[table]).parquet(*(f"{self.path}/{folder}" for folder in folders))

    def _write(self, table: str, rows: DataFrame) -> str:
        folder = f"{table}/{uuid.uuid4().hex}"
        fields = self.spark.createDataFrame([], SCHEMAS[table]).schema
        rows.select([F.col(f.name).cast(f.dataType) for f in fields]).write.parquet(f"{self.path}/{folder}")
        return folder

    def _commit(self, added: dict[str, DataFrame], replaced: dict[str, DataFrame]) -> None:
        record = self._record()
        tables, last = dict(record["tables"]), dict(record["last"])
        for table, rows in {**added, **replaced}.items():
            folder = self._write(table, rows)
            if table in IDS:
                last[table] = max(last.get(table, 0), self._rows(table, [folder]).agg(F.max(IDS[table])).first()[0] or 0)
            folders = [*tables.get(table, []), folder] if table in added else [folder]
            if len(folders) > MOST_FOLDERS:
                folders = [self._write(table, self._rows(table, folders))]
            tables[table] = folders
        number = int(self._commits()[-1].partition(".")[0]) + 1 if self._commits() else 1
        out = self._fs().create(self._at(f"commits/{number:012d}.json"), False)  # fails if another writer took the number
        out.write(bytearray(json.dumps({"tables": tables, "last": last}).encode() + b"\n"))
        out.close()

    def _record(self) -> dict:
        """The last whole record; one that a writer left unfinished has no line end and doesn't count."""
        for name in reversed(self._commits()):
            stream = self._fs().open(self._at(f"commits/{name}"))
            try:
                text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            finally:
                stream.close()
            if text.endswith("\n"):
                return json.loads(text) | {"name": name}
        return {"tables": {}, "last": {}, "name": None}

    def _commits(self) -> list[str]:
        return sorted(n for n in (s.getPath().getName() for s in self._list("commits")) if n.endswith(".json"))

    def _list(self, folder: str) -> list:
        return list(self._fs().globStatus(self._at(f"{folder}/*")) or [])

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _fs(self):
        return self._at("commits").getFileSystem(self.spark._jsc.hadoopConfiguration())
