"""A small catalogue of Parquet tables with keyed writes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotusflow import schemas
from lotusflow.operators.dense import check_dimension
from lotusflow.operators.indexing import remove_keys, storable, upsert
from lotusflow.operators.memory import duplicate_turns

#: Key columns and schema of each table.
TABLES = {
    "sources": (["id"], schemas.SOURCE),
    "documents": (["id"], schemas.DOCUMENT),
    "chunks": (["id"], schemas.CHUNK),
    "index_entries": (["chunk_id"], schemas.INDEX_ENTRY),
    "query_cache": (["cache_key"], schemas.QUERY_CACHE),
    "chat_sessions": (["session_id"], schemas.CHAT_SESSION),
    "chat_turns": (["id"], schemas.CHAT_TURN),
}


class Store:
    """Tables under one folder; reads are lazy DataFrames, a missing table is empty.

    Every save writes a new version of the table beside the old one and then names it in
    a small file, so a failed write leaves the table as it was, and readers of the old
    version go on. The version before is kept, older ones are removed.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _file(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _version(self, name: str) -> int:
        """Number of the current version; 0 without any."""
        fs, p = self._file(f"{self.root}/{name}")
        if not fs.exists(p):
            return 0
        marks = [s.getPath().getName() for s in fs.listStatus(p)]
        return max((int(m[8:]) for m in marks if m.startswith("current-")), default=0)

    def _path(self, name: str, version: int) -> str:
        return f"{self.root}/{name}/v{version}.parquet"

    def exists(self, name: str) -> bool:
        """Whether the table has been written."""
        return self._version(name) > 0

    def table(self, name: str) -> DataFrame:
        """The rows of a table."""
        version = self._version(name)
        if not version:
            return self.spark.createDataFrame([], TABLES[name][1])
        return self.spark.read.schema(TABLES[name][1]).parquet(self._path(name, version))

    def replace(self, name: str, rows: DataFrame) -> None:
        """Make the rows the new version of a table."""
        version = self._version(name) + 1
        rows.write.mode("overwrite").parquet(self._path(name, version))
        fs, mark = self._file(f"{self.root}/{name}/current-{version}")
        fs.create(mark).close()
        for old in range(1, version - 1):
            for path in (self._path(name, old), f"{self.root}/{name}/current-{old}"):
                fs, p = self._file(path)
                if fs.exists(p):
                    fs.delete(p, True)

    def save(self, name: str, rows: DataFrame) -> None:
        """Insert rows; a row whose key exists replaces all its columns."""
        self.replace(name, upsert(self.table(name), rows, TABLES[name][0]) if self.exists(name) else rows)

    def remove(self, name: str, gone: DataFrame) -> None:
        """Remove the rows of some keys."""
        self.replace(name, remove_keys(self.table(name), gone, TABLES[name][0]))

    def create_collection(self, dim: int, recreate: bool = False) -> None:
        """Begin the collection of index entries with vectors of ``dim`` values.

        A collection that exists is kept if its vectors have that length; otherwise it is
        an error, unless ``recreate`` empties it.
        """
        known = self.collection_dim()
        if known is not None and not recreate:
            if known != dim:
                raise ValueError(f"the collection holds vectors of {known} values, not {dim}")
            return
        self.replace("index_entries", self.spark.createDataFrame([], TABLES["index_entries"][1]))

    def collection_dim(self) -> int | None:
        """Length of the vectors in the collection; none without a vector."""
        found = self.table("index_entries").where(F.col("dense_vector").isNotNull()).select(F.size("dense_vector").alias("n")).first()
        return None if found is None else found["n"]

    def save_entries(self, entries: DataFrame) -> None:
        """Insert index entries by chunk; those without any vector are skipped, vectors of another length are an error."""
        dim = self.collection_dim()
        if dim is not None:
            check_dimension(entries, "dense_vector", dim)
        self.save("index_entries", storable(entries))

    def get(self, name: str, ids: Sequence[str]) -> DataFrame:
        """Rows with the given keys; unknown keys give nothing."""
        return self.table(name).where(F.col(TABLES[name][0][0]).isin(list(ids)))

    def entries(self, chunk_ids: DataFrame | None = None) -> DataFrame:
        """Index entries ordered by chunk, or those of ``chunk_ids (chunk_id)``."""
        rows = self.table("index_entries")
        return rows.orderBy("chunk_id") if chunk_ids is None else rows.join(chunk_ids.select("chunk_id").distinct(), "chunk_id", "left_semi")

    def documents(self, source_id: str | None = None, status: str | None = None) -> DataFrame:
        """Documents by source and status, ordered by id."""
        rows = self.table("documents")
        if source_id is not None:
            rows = rows.where(F.col("source_id") == source_id)
        if status is not None:
            rows = rows.where(F.col("status") == status)
        return rows.orderBy("id")

    def sources(self, tenant_id: str | None = None) -> DataFrame:
        """Sources of a tenant, ordered by id."""
        rows = self.table("sources")
        return (rows if tenant_id is None else rows.where(F.col("tenant_id") == tenant_id)).orderBy("id")

    def chunks(self, document_id: str) -> DataFrame:
        """Chunks of a document in order."""
        return self.table("chunks").where(F.col("document_id") == document_id).orderBy("chunk_order")

    def turns(self, session_id: str) -> DataFrame:
        """Turns of a session in order."""
        return self.table("chat_turns").where(F.col("session_id") == session_id).orderBy("turn_no")

    def has_session(self, session_id: str) -> bool:
        """Whether a session exists."""
        return not self.table("chat_sessions").where(F.col("session_id") == session_id).isEmpty()

    def start_turn(self, turns: DataFrame) -> None:
        """Add turns that have no answer yet; a number that its session has already is an error."""
        both = self.table("chat_turns").unionByName(turns.select(*self.table("chat_turns").columns))
        if not duplicate_turns(both).isEmpty():
            raise ValueError("a session has a turn of that number")
        self.save("chat_turns", turns)

    def finish_turn(self, turns: DataFrame) -> None:
        """Write the answers of turns that were started."""
        self.save("chat_turns", turns)

    def clear_cache(self) -> int:
        """Empty the cache of queries; returns how many entries it had."""
        n = self.table("query_cache").count()
        self.replace("query_cache", self.spark.createDataFrame([], TABLES["query_cache"][1]))
        return n

    def summary(self) -> dict[str, int]:
        """Rows per table."""
        return {name: self.table(name).count() for name in TABLES}
