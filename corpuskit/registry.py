"""Implementations by name; an unknown name is an error that lists the known ones."""

from __future__ import annotations

from corpuskit.operators.collection import Collection
from corpuskit.operators.embedding import HashingEmbedder, SentenceModel, TokenModel
from corpuskit.operators.provider import EchoProvider, LocalProvider

EMBEDDERS = {"hashing": HashingEmbedder, "sentence": SentenceModel, "tokens": TokenModel}
PROVIDERS = {"echo": EchoProvider, "local": LocalProvider}
STORES = {"parquet": Collection}


def _made(kinds: dict, name: str, *args, **options):
    if name.lower() not in kinds:
        raise ValueError(f"unknown name {name!r}; known: {', '.join(sorted(kinds))}")
    return kinds[name.lower()](*args, **options)


def get_embedder(name: str, **options):
    return _made(EMBEDDERS, name, **options)


def get_provider(name: str, **options):
    return _made(PROVIDERS, name, **options)


def get_store(name: str, spark, **options):
    return _made(STORES, name, spark, **options)
