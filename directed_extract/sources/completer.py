"""Model servers behind one small interface; the only place where rows leave the JVM for a call."""

from __future__ import annotations

import http.client
import json
import time
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, field
from typing import Protocol
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from directed_extract.session import cut

# Options of every call, and how long the server keeps the model.
OPTIONS = {
    "top_p": 0.9, "num_gpu": 1, "num_thread": 2, "repeat_penalty": 1.1, "top_k": 40, "num_predict": 32,
    "stop": ["\nUser:", "\nUSER:", "\nAssistant:", "\nASSISTANT:", "```", "```json"],
}
KEEP_ALIVE = "5m"
# Fixed value: the answer that stands for a failed call, a valid empty list.
FAILED = '{"present": [], "evidence": {}}'
# Server, seconds until a call is given up, calls for one prompt, seconds between them, calls at once.
SERVER = "http://localhost:11434/api/generate"
TIMEOUT, ATTEMPTS, PAUSE, CALLS_AT_ONCE = 30.0, 3, 1.0, 4


class Completer(Protocol):
    def complete(self, model: str, system: str, prompt: str, temperature: float) -> str: ...


@dataclass(frozen=True)
class StaticCompleter:
    """Recorded answers by prompt; anything else gets ``default``."""

    answers: Mapping[str, str]
    default: str = "[]"

    def complete(self, model: str, system: str, prompt: str, temperature: float) -> str:
        return self.answers.get(prompt, self.default)


@dataclass(frozen=True)
class FunctionCompleter:
    """Answers from a function of model and prompt."""

    function: Callable[[str, str], str]

    def complete(self, model: str, system: str, prompt: str, temperature: float) -> str:
        return self.function(model, prompt)


@dataclass(frozen=True)
class HttpCompleter:
    """A model server that takes one prompt a POST and answers with an envelope ``{"response": text}`` or plain text.

    Each task keeps its connection open from call to call. A broken connection is dropped, so that the next attempt
    opens a new one. Any status but 2xx is an error.
    """

    url: str = SERVER
    timeout: float = TIMEOUT
    options: Mapping[str, object] = field(default_factory=lambda: dict(OPTIONS))
    keep_alive: str = KEEP_ALIVE

    def body(self, model: str, system: str, prompt: str, temperature: float) -> dict:
        return {"model": model, "prompt": prompt, "system": system, "stream": False, "keep_alive": self.keep_alive, "options": {**self.options, "temperature": temperature}}

    def complete(self, model: str, system: str, prompt: str, temperature: float) -> str:
        return self.opened().complete(model, system, prompt, temperature)

    def opened(self) -> Connected:
        """The same server with a connection that stays open: one for each task."""
        return Connected(self)


class Connected:
    """A worker's own connection to a model server."""

    def __init__(self, server: HttpCompleter) -> None:
        self.server, self.kept = server, None

    def complete(self, model: str, system: str, prompt: str, temperature: float) -> str:
        raw = self._post(json.dumps(self.server.body(model, system, prompt, temperature)).encode())
        try:
            answer = json.loads(raw).get("response", raw)
        except (ValueError, AttributeError):
            return raw
        return answer if isinstance(answer, str) else raw

    def _post(self, payload: bytes) -> str:
        at = urlsplit(self.server.url)
        try:
            if self.kept is None:
                kind = http.client.HTTPSConnection if at.scheme == "https" else http.client.HTTPConnection
                self.kept = kind(at.hostname, at.port, timeout=self.server.timeout)
            self.kept.request("POST", at.path or "/", payload, {"Content-Type": "application/json"})
            reply = self.kept.getresponse()
            raw = reply.read().decode("utf-8", "replace")
            if reply.status // 100 != 2:
                raise ConnectionError(f"status {reply.status}")
            return raw
        except (OSError, http.client.HTTPException):
            if self.kept is not None:
                self.kept.close()
            self.kept = None
            raise


def called(completer: Completer, model: str, system: str, prompt: str, temperature: float, attempts: int, pause: float) -> tuple[str, str, int, float, str | None]:
    """Answer, status, attempts, seconds and last error of one prompt. Errors other than of calling are not hidden."""
    began, error = time.monotonic(), None
    for n in range(1, attempts + 1):
        try:
            return completer.complete(model, system, prompt, temperature), "ok", n, round(time.monotonic() - began, 3), error
        except (OSError, http.client.HTTPException) as e:
            error = f"{type(e).__name__}: {e}"
            if n < attempts:
                time.sleep(pause)
    return FAILED, "failed", attempts, round(time.monotonic() - began, 3), error


def complete_prompts(
    asked: DataFrame, completer: Completer, system: str, heat: Mapping[int, float], calls_at_once: int | None = None, attempts: int = ATTEMPTS, pause: float = PAUSE, most_failed: float = 1.0
) -> DataFrame:
    """``(key, answer, status, attempts, seconds, error)`` of ``asked``: distinct prompts ``(key, model, prompt, ord)``.

    ``calls_at_once`` bounds how many tasks call at a time. A call that fails is made again after ``pause`` seconds, at
    most ``attempts`` times; then the row has the status ``failed`` and the answer :data:`FAILED`, an empty list. More than
    ``most_failed`` of all rows failed is an error, so that an outage does not pass for texts without entities. The answers
    are written to the checkpoint folder: whatever runs again later does not call again.
    """
    rows = asked.select("key", "model", "prompt", "ord")
    rows = rows.repartition(calls_at_once) if calls_at_once else rows

    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        server = completer.opened() if isinstance(completer, HttpCompleter) else completer
        for b in batches:
            got = [called(server, m, system, p, heat.get(int(o), 0.0), attempts, pause) for m, p, o in zip(b["model"], b["prompt"], b["ord"], strict=True)]
            answers = pd.DataFrame(got, columns=["answer", "status", "attempts", "seconds", "error"])
            yield pd.concat([b[["key"]].reset_index(drop=True), answers], axis=1)

    done = cut(rows.mapInPandas(call, "key string, answer string, status string, attempts int, seconds double, error string"))
    if most_failed < 1:
        n = done.agg(F.count("*").alias("n"), F.count_if(F.col("status") == "failed").alias("f"), F.max("error").alias("e")).first()
        if n.f > most_failed * n.n:
            raise RuntimeError(f"{n.f} of {n.n} model calls failed, last: {n.e}")
    return done


def call_tally(calls: DataFrame, *by: str) -> DataFrame:
    """By status (and ``by``): calls, attempts, and the seconds they took."""
    return calls.groupBy(*by, "status").agg(F.count("*").alias("n_calls"), F.sum("attempts").alias("n_attempts"), F.round(F.sum("seconds"), 3).alias("seconds"))


def live_entries(cache: DataFrame, now: str, capacity: int) -> DataFrame:
    """The entries of a cache ``(key, expiry, ...)`` that still count at ``now``.

    Expired entries go first; if the rest has reached ``capacity``, so does its oldest quarter by expiry (ties by key).
    """
    alive = cache.filter(F.col("expiry") > F.lit(now).cast("timestamp_ntz"))
    n = alive.count()
    if n < capacity:
        return alive
    return alive.join(alive.orderBy("expiry", "key").limit(n // 4).select("key"), "key", "left_anti")
