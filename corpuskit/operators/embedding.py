"""Text to vectors: an interface for models, and one that needs no model."""

from __future__ import annotations

import hashlib
from abc import ABC, abstractmethod
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def as_list(texts: str | list[str]) -> list[str]:
    """A text or a list of them as a list; an empty list is an error."""
    found = [texts] if isinstance(texts, str) else list(texts)
    if not found:
        raise ValueError("no texts to encode")
    return found


class Embedder(ABC):
    """A model. load() runs once for each worker; embed() takes one batch."""

    dimension: int

    def load(self):
        return None

    @abstractmethod
    def embed(self, model, texts: list[str]) -> np.ndarray: ...

    @property
    def embedding_dim(self) -> int:
        return self.dimension

    def encode(self, texts: str | list[str], batch_size: int = 32, normalize: bool = False) -> np.ndarray:
        """float32 rows for texts, on the driver."""
        found = as_list(texts)
        try:
            model = self.load()
            rows = np.vstack([self.embed(model, found[i : i + batch_size]) for i in range(0, len(found), batch_size)]).astype(np.float32)
        except Exception as e:
            raise RuntimeError(f"encoding failed: {e}") from e
        return unit(rows) if normalize else rows


def unit(rows: np.ndarray) -> np.ndarray:
    return (rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)).astype(np.float32)


class HashingEmbedder(Embedder):
    """Signed counts of hashed words and word pairs; the same everywhere, without a network."""

    def __init__(self, dimension: int = 64):
        self.dimension = dimension

    def embed(self, model, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dimension))
        for row, text in zip(out, texts, strict=True):
            words = text.lower().split()
            for term in [*words, *(f"{a} {b}" for a, b in zip(words, words[1:], strict=False))]:
                h = int.from_bytes(hashlib.blake2b(term.encode(), digest_size=8).digest(), "little")
                row[h % self.dimension] += 1 if h >> 63 else -1
        return out


class SentenceModel(Embedder):
    """A sentence-transformers model, where that library and the model are installed."""

    def __init__(self, model: str, dimension: int):
        self.name, self.dimension = model, dimension

    def load(self):
        from sentence_transformers import SentenceTransformer

        return SentenceTransformer(self.name)

    def embed(self, model, texts: list[str]) -> np.ndarray:
        return np.asarray(model.encode(texts))


class TokenModel(Embedder):
    """A transformer whose last hidden states are pooled under the attention mask."""

    def __init__(self, model: str, dimension: int, max_length: int = 512):
        self.name, self.dimension, self.max_length = model, dimension, max_length

    def load(self):
        from transformers import AutoModel, AutoTokenizer

        return AutoTokenizer.from_pretrained(self.name), AutoModel.from_pretrained(self.name).eval()

    def embed(self, model, texts: list[str]) -> np.ndarray:
        import torch

        tokenizer, network = model
        given = tokenizer(texts, padding=True, truncation=True, max_length=self.max_length, return_tensors="pt")
        with torch.no_grad():
            states = network(**given).last_hidden_state
        mask = given["attention_mask"].unsqueeze(-1).float()
        return ((states * mask).sum(1) / mask.sum(1).clamp(min=1e-9)).numpy()


def encode(df: DataFrame, embedder: Embedder, text: str = "text", output: str = "embedding", batch_size: int = 32, normalize: bool = False) -> DataFrame:
    """df with a column of vectors; the model is loaded once for each task, texts go through it in batches. Null texts give null."""

    @F.arrow_udf("array<float>")
    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = embedder.load()
        for column in columns:
            texts = column.to_pylist()
            at = [i for i, t in enumerate(texts) if t is not None]
            rows: list = [None] * len(texts)
            for low in range(0, len(at), batch_size):
                some = at[low : low + batch_size]
                found = np.asarray(embedder.embed(model, [texts[i] for i in some]), np.float32)
                for i, v in zip(some, unit(found) if normalize else found, strict=True):
                    rows[i] = v
            yield pa.array(rows, pa.list_(pa.float32()))

    return df.withColumn(output, run(F.col(text)))


def batch_numbers(df: DataFrame, order: str, size: int = 32) -> DataFrame:
    """df with batch: rows in an order, size at a time.

    Ordering all rows in one place would not scale, so rows are range-partitioned, numbered inside
    their partitions and moved by the partitions' counts (one number for each partition).
    """
    parts = df.repartitionByRange(F.col(order)).withColumn("__part", F.spark_partition_id())
    rank = F.row_number().over(Window.partitionBy("__part").orderBy(order)) - 1
    counts = parts.groupBy("__part").count()
    before = counts.withColumn("__before", F.coalesce(F.sum("count").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("count")
    return parts.withColumn("__n", rank).join(before, "__part").withColumn("batch", F.floor((F.col("__n") + F.col("__before")) / size)).drop("__part", "__n", "__before")
