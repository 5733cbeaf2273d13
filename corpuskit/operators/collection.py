"""Vector collections: named, persistent tables with insert, update, delete and filtered top-k search.

A collection is a folder of numbered snapshots. A change writes the next one beside them and renames it
to its number, so readers see all of it or nothing; the one before stays for readers that still have it.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuskit import schemas
from corpuskit.functions.vectors import cosine_distance

#: Ids to delete travel as a broadcast up to so many; beyond it the join shuffles.
BROADCAST_IDS = 100_000


def compile_filter(where: dict | None, field) -> Column:
    """A metadata filter as a column: {key: value}, {key: {$eq $ne $gt $gte $lt $lte $in $nin: ...}}, {$and: [...]}, {$or: [...]}. field: key to column."""
    out = F.lit(True)
    for key, want in (where or {}).items():
        if key in ("$and", "$or"):
            parts = [compile_filter(w, field) for w in want]
            joined = parts[0]
            for p in parts[1:]:
                joined = joined & p if key == "$and" else joined | p
            out = out & joined
            continue
        c = field(key)
        for op, value in (want if isinstance(want, dict) else {"$eq": want}).items():
            match op:
                case "$eq":
                    out = out & (c == F.lit(value))
                case "$ne":
                    out = out & (c.isNull() | (c != F.lit(value)))
                case "$gt":
                    out = out & (c > F.lit(value))
                case "$gte":
                    out = out & (c >= F.lit(value))
                case "$lt":
                    out = out & (c < F.lit(value))
                case "$lte":
                    out = out & (c <= F.lit(value))
                case "$in":
                    out = out & c.isin(*value)
                case "$nin":
                    out = out & (c.isNull() | ~c.isin(*value))
                case _:
                    raise ValueError(f"unknown operator {op}")
    return out


def metadata_field(key: str) -> Column:
    return F.element_at("metadata", key)


def compile_metadata_filter(where: dict | None) -> Column:
    """compile_filter on metadata, which is kept as text: numbers are compared as numbers, with values that are none counting as missing."""

    class Field:
        """Picks the typed form of a key by the value that it is compared with."""

        def __init__(self, key: str):
            self.text = metadata_field(key)

        def of(self, value) -> Column:
            some = value[0] if isinstance(value, (list, tuple)) and value else value
            if isinstance(some, bool):
                return self.text.try_cast("boolean")
            return self.text.try_cast("double") if isinstance(some, (int, float)) else self.text

    out = F.lit(True)
    for key, want in (where or {}).items():
        if key in ("$and", "$or"):
            out = out & reduce((lambda a, b: a & b) if key == "$and" else (lambda a, b: a | b), map(compile_metadata_filter, want))
            continue
        for op, value in (want if isinstance(want, dict) else {"$eq": want}).items():
            out = out & compile_filter({key: {op: value}}, lambda k, v=value: Field(k).of(v))
    return out


def _literal(vector) -> Column:
    return F.array(*(F.lit(float(x)) for x in vector))


def nearest(documents: DataFrame, vector, k: int = 10, where: Column | None = None, key: str = "id", embedding: str = "embedding") -> DataFrame:
    """The k rows nearest to a vector, with score: the cosine distance, smallest first, no direction last, ties by key."""
    rows = documents if where is None else documents.filter(where)
    scored = rows.withColumn("score", cosine_distance(F.col(embedding), vector if isinstance(vector, Column) else _literal(vector)))
    return scored.orderBy(F.col("score").asc_nulls_last(), key).limit(k)


def nearest_batch(documents: DataFrame, queries: DataFrame, k: int = 5, key: str = "id", embedding: str = "embedding", query: str = "query_id", vector: str = "query_vector") -> DataFrame:
    """query, key, score, rank: the k nearest of each query vector; null vectors take no part.

    The documents' blocks meet the queries' chunks in tasks that return k rows for each query, by one
    matrix product each; the blocks' winners are then ranked.
    """
    import numpy as np
    import pyarrow as pa
    from pyspark.sql.window import Window

    # vectors that are null or hold nulls are near nothing; only vectors of one length meet
    whole = lambda c: F.col(c).isNotNull() & F.forall(c, lambda x: x.isNotNull())
    documents, queries = documents.filter(whole(embedding)), queries.filter(whole(vector))
    sizes = (documents.count() // 8192 + 1, queries.count() // 1024 + 1)
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    d = documents.select(F.col(key).alias("id"), F.col(embedding).cast("array<double>").alias("v"), F.lit(False).alias("q"), deal(key, sizes[0]).alias("b"), every(sizes[1]).alias("c"))
    q = queries.select(F.col(query).alias("id"), F.col(vector).cast("array<double>").alias("v"), F.lit(True).alias("q"), every(sizes[0]).alias("b"), deal(query, sizes[1]).alias("c"))
    kind = documents.schema[key].dataType.simpleString()

    def tile(t: pa.Table) -> pa.Table:
        asked, ids = t.column("q").to_numpy(), np.array(t.column("id").to_pylist())
        v = t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
        x, y = v[asked], v[~asked]
        own, other = ids[asked], ids[~asked]
        if not len(x) or not len(y):
            return pa.table({"query": ids[:0], "id": ids[:0], "score": np.zeros(0)})
        lengths = np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(y, axis=1)[None]
        with np.errstate(invalid="ignore", divide="ignore"):
            score = np.where(lengths > 0, 1 - (x @ y.T) / lengths, np.inf)
        best = np.stack([np.lexsort((other, s))[:k] for s in score])
        return pa.table({"query": np.repeat(own, best.shape[1]), "id": other[best.ravel()], "score": np.take_along_axis(score, best, 1).ravel()})

    found = d.unionByName(q).withColumn("dim", F.size("v")).groupBy("dim", "b", "c").applyInArrow(tile, f"query {kind}, id {kind}, score double")
    rank = F.row_number().over(Window.partitionBy("query").orderBy("score", "id"))
    ranked = found.withColumn("rank", rank).filter(F.col("rank") <= k)
    return ranked.select(F.col("query").alias(query), F.col("id").alias(key), F.when(F.col("score") < float("inf"), F.col("score")).alias("score"), "rank")


def invalid(documents: DataFrame) -> DataFrame:
    return documents.filter(F.col("id").isNull() | F.col("embedding").isNull())


def inserted(current: DataFrame, new: DataFrame) -> DataFrame:
    """current and the rows of new whose id it lacks."""
    return current.unionByName(new.join(current.select("id"), "id", "left_anti").select(*current.columns))


def deleted(current: DataFrame, ids: DataFrame) -> DataFrame:
    return current.join(ids.select("id"), "id", "left_anti")


def updated(current: DataFrame, changes: DataFrame) -> DataFrame:
    """Rows of current with the non-null fields of changes (id, content, embedding, metadata) in place of theirs; metadata is merged by key."""
    # of several changes of one id, one counts, so that rows stay as many
    c = changes.dropDuplicates(["id"]).select("id", *(F.col(x).alias(f"__{x}") for x in ("content", "embedding", "metadata")))
    merged = F.when(F.col("__metadata").isNull(), F.col("metadata")).when(F.col("metadata").isNull(), F.col("__metadata")).otherwise(
        F.map_concat(F.map_filter("metadata", lambda k, v: ~F.array_contains(F.map_keys("__metadata"), k)), F.col("__metadata"))
    )
    return current.join(c, "id", "left").select("id", F.coalesce("__content", "content").alias("content"), F.coalesce("__embedding", "embedding").alias("embedding"), merged.alias("metadata"))


class Collection:
    """A persistent collection of (id, content, embedding, metadata)."""

    def __init__(self, spark: SparkSession, name: str = "default_collection", directory: str = "vector_collections"):
        self.spark, self.root = spark, f"{directory.rstrip('/')}/{name}"

    def _path(self, path: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)

    def _fs(self):
        return self._path(self.root).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _snapshots(self) -> list[int]:
        """Numbers of the finished snapshots, ascending."""
        if not self._fs().exists(self._path(self.root)):
            return []
        names = [f.getPath().getName() for f in self._fs().listStatus(self._path(self.root))]
        return sorted(int(n.removeprefix("snapshot-")) for n in names if n.removeprefix("snapshot-").isdigit())

    def _current(self) -> str | None:
        found = self._snapshots()
        return f"snapshot-{found[-1]}" if found else None

    def _replace(self, rows: DataFrame) -> None:
        made = f"{self.root}/new-{uuid.uuid4().hex}"
        rows.select(*schemas.DOCUMENT.names).write.parquet(made)
        found = self._snapshots()
        if not self._fs().rename(self._path(made), self._path(f"{self.root}/snapshot-{found[-1] + 1 if found else 0}")):
            raise RuntimeError("the snapshot could not be put in place")
        for old in found[:-1]:
            self._fs().delete(self._path(f"{self.root}/snapshot-{old}"), True)

    def rows(self) -> DataFrame:
        at = self._current()
        return self.spark.createDataFrame([], schemas.DOCUMENT) if at is None else self.spark.read.schema(schemas.DOCUMENT).parquet(f"{self.root}/{at}")

    def _frame(self, documents) -> DataFrame:
        if isinstance(documents, DataFrame):
            return documents
        rows = [(None if d.get("id") is None else str(d["id"]), d.get("content", ""), None if d.get("embedding") is None else [float(x) for x in d["embedding"]], None if d.get("metadata") is None else {k: None if v is None else str(v) for k, v in d["metadata"].items()}) for d in documents]
        return self.spark.createDataFrame(rows, schemas.DOCUMENT)

    def add(self, documents) -> None:
        """Insert documents, as dicts or rows. An empty batch, or a document without id or embedding, rejects the batch; known ids are left as they are."""
        new = self._frame(documents)
        if new.isEmpty():
            raise RuntimeError("no documents to add")
        if not invalid(new).isEmpty():
            raise RuntimeError("every document needs an id and an embedding")
        new = new.select(F.col("id").cast("string").alias("id"), F.coalesce("content", F.lit("")).alias("content"), F.col("embedding").cast("array<float>").alias("embedding"), "metadata").dropDuplicates(["id"])
        self._replace(inserted(self.rows(), new))

    def delete(self, ids: list[str]) -> None:
        """Ids that are not there do no harm; an empty list changes nothing."""
        if ids:
            gone = self.spark.createDataFrame([(str(i),) for i in ids], "id string")
            self._replace(deleted(self.rows(), F.broadcast(gone) if len(ids) <= BROADCAST_IDS else gone))

    def update(self, document: dict) -> None:
        """Replace the fields that are given; the id must be there, and an embedding given."""
        if document.get("embedding") is None:
            raise ValueError("an update needs an embedding")
        if self.get(document.get("id")) is None:
            raise ValueError(f"no document {document.get('id')!r}")
        change = self._frame([document | {"content": document.get("content")}])
        self._replace(updated(self.rows(), change))

    def get(self, ident) -> dict | None:
        """A document by its id, with score None; None where there is none."""
        row = self.rows().filter(F.col("id") == str(ident)).select("id", "content", "metadata").first()
        return None if row is None else row.asDict() | {"score": None}

    def count(self) -> int:
        return self.rows().count()

    def clear(self) -> None:
        self._replace(self.rows().limit(0))

    def query(self, vector, filters: dict | None = None, top_k: int = 10) -> DataFrame:
        return nearest(self.rows(), vector, top_k, compile_metadata_filter(filters)).select(*schemas.MATCH.names)
