"""Language-model providers: an interface, an offline echo, and a client of a local HTTP server."""

from __future__ import annotations

import json
from abc import ABC, abstractmethod
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Provider(ABC):
    def __init__(self, **config):
        self.config = config

    @property
    def name(self) -> str:
        return type(self).__name__.removesuffix("Provider").lower()

    @abstractmethod
    def generate(self, prompt: str, stream: bool = False, **options): ...

    @abstractmethod
    def chat(self, messages: list[dict], stream: bool = False, **options): ...

    @abstractmethod
    def embed(self, text: str, **options): ...


class EchoProvider(Provider):
    """Answers with what it was asked, word by word when streaming; for tests and dry runs."""

    def _chunks(self, text: str) -> Iterator[dict]:
        words = text.split(" ")
        for i, w in enumerate(words):
            yield {"response": w + (" " if i < len(words) - 1 else ""), "done": False}
        yield {"response": "", "done": True, "eval_count": len(words), "eval_duration": 1_000_000_000, "total_duration": 2_000_000_000}

    def generate(self, prompt, stream=False, **options):
        return self._chunks(prompt) if stream else prompt

    def chat(self, messages, stream=False, **options):
        return self.generate(messages[-1]["content"] if messages else "", stream)

    def embed(self, text, **options):
        from corpuskit.operators.embedding import HashingEmbedder

        return {"embeddings": HashingEmbedder().encode(text).tolist()}


def lines_until(lines: Iterator[bytes], last) -> Iterator[dict]:
    """JSON objects of the non-empty lines, up to and with the first for which last() holds."""
    for line in lines:
        if line:
            found = json.loads(line.decode() if isinstance(line, bytes) else line)
            yield found
            if last(found):
                return


def message_content(body: str) -> str:
    """message.content of a body, stripped; empty where the body is not one JSON object with it."""
    try:
        return json.loads(body).get("message", {}).get("content", "").strip()
    except ValueError:
        return ""


class LocalProvider(Provider):
    """A model server on this host, spoken to in JSON over HTTP. Network errors are printed and give None."""

    def __init__(self, api_url: str = "http://localhost:11434", model: str = "llama3.2", session=None, **config):
        super().__init__(**config)
        self.api_url, self.model, self.session = api_url.rstrip("/"), model, session

    def set_model(self, name: str) -> None:
        self.model = name

    def _call(self, method: str, path: str, payload: dict | None = None, stream: bool = False):
        import requests

        try:
            got = (self.session or requests).request(method, f"{self.api_url}{path}", json=payload, stream=stream)
            got.raise_for_status()
            return got
        except requests.RequestException as e:
            print(f"{method} {path}: {e}")
            return None

    def _ask(self, path: str, payload: dict, stream: bool):
        got = self._call("POST", path, {"model": self.model, "stream": stream} | payload, stream)
        if got is None:
            return None
        return lines_until(got.iter_lines(), lambda c: c.get("done")) if stream else message_content(got.text)

    def generate(self, prompt, stream=False, **options):
        return self._ask("/api/generate", {"prompt": prompt} | options, stream)

    def chat(self, messages, stream=False, **options):
        return self._ask("/api/chat", {"messages": messages} | options, stream)

    def _json(self, method: str, path: str, payload: dict | None = None):
        got = self._call(method, path, payload)
        return None if got is None else got.json()

    def embed(self, text, **options):
        return self._json("POST", "/api/embed", {"model": self.model, "input": text} | options)

    def list_models(self):
        return self._json("GET", "/api/tags")

    def model_info(self, verbose: bool = False):
        return self._json("POST", "/api/show", {"model": self.model, "verbose": verbose})

    def version(self):
        return self._json("GET", "/api/version")

    def delete(self, name: str) -> bool:
        return self._call("DELETE", "/api/delete", {"model": name}) is not None

    def pull_model(self, model: str, stream: bool = False, insecure: bool = False, **options):
        got = self._call("POST", "/api/pull", {"model": model, "stream": stream, "insecure": insecure} | options, stream)
        if got is None:
            return None
        return lines_until(got.iter_lines(), lambda c: c.get("status") == "success") if stream else got.json()

    def download(self, model: str) -> None:
        """Pull a model with a bar on the console."""
        for c in self.pull_model(model, stream=True) or ():
            if c.get("total"):
                part = c.get("completed", 0) / c["total"]
                full = int(40 * part)
                print(f"\r{c.get('digest', '')[:12]} [{'█' * full}{'░' * (40 - full)}] {100 * part:5.1f}% {c.get('completed', 0) / 1048576:.1f} MB", end="", flush=True)
            else:
                print(f"\n{c.get('status', '')}", end="", flush=True)
        print()


def generate(df: DataFrame, provider: Provider, prompt: str = "prompt", output: str = "answer") -> DataFrame:
    """df with each prompt's answer; the provider travels to the executors."""

    @F.arrow_udf("string")
    def run(prompts: pa.Array) -> pa.Array:
        return pa.array([None if p is None else provider.generate(p) for p in prompts.to_pylist()], pa.string())

    return df.withColumn(output, run(F.col(prompt)))


def chat_history(turns: DataFrame, conversation: str = "conv_id", turn: str = "turn") -> DataFrame:
    """conversation, messages: its turns (role, text) in order as an array of role and content."""
    listed = turns.groupBy(conversation).agg(F.array_sort(F.collect_list(F.struct(turn, "role", F.col("text").alias("content")))).alias("l"))
    return listed.select(conversation, F.transform("l", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("messages"))
