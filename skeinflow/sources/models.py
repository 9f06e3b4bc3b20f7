"""Models and servers outside: requests, answers, retries, and plug-ins that run in Arrow batches.

Nothing here opens a connection by itself: ``send``, ``fetch`` and ``head`` are functions
that the caller gives, so tests and offline runs use recorded ones.
"""

from __future__ import annotations

import hashlib
import random
import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skeinflow.functions.text import estimate_tokens

BACKENDS = ("openai", "llamacpp", "ollama")
#: What the servers call the options.
OPTION_NAMES = {"ollama": {"max_tokens": "num_predict", "seed": "seed", "top_p": "top_p", "stop": "stop"}, "openai": {"max_tokens": "max_tokens", "seed": "seed", "top_p": "top_p", "stop": "stop", "response_format": "response_format"}}


class ConfigError(ValueError):
    """The request can't be made; trying again won't help."""


class EmptyAnswer(RuntimeError):
    """The server answered without content."""


class HTTPFailure(RuntimeError):
    def __init__(self, status: int, text: str = "") -> None:
        super().__init__(f"HTTP {status} {text}".strip())
        self.status = status


@dataclass
class Answer:
    text: str
    finish_reason: str | None = None
    prompt_tokens: int | None = None
    completion_tokens: int | None = None

    @property
    def tokens(self) -> int | None:
        """Of prompt and completion together, where the server told both."""
        return None if self.prompt_tokens is None or self.completion_tokens is None else self.prompt_tokens + self.completion_tokens


def call_tokens(prompt: Column | str, completion: Column | str) -> Column:
    """Tokens of a call, estimated from prompt and completion; null texts have none."""
    return sum((F.coalesce(estimate_tokens(c), F.lit(0)) for c in (prompt, completion)), F.lit(0))


def clean_base_url(url: str) -> str:
    """Without slashes and the version at its end."""
    return url.strip().rstrip("/").removesuffix("/v1").rstrip("/")


def backend_of(model: str, base_url: str, told: str | None = None) -> str:
    """The kind of server: as told, else by the model's prefix, else by the address."""
    if told:
        if told not in BACKENDS:
            raise ConfigError(f"unknown backend {told!r}")
        return told
    address = base_url.lower()
    named = {"llamacpp": model.startswith("llamacpp/"), "ollama": "ollama" in address or address.rstrip("/").endswith(":11434") or ":11434/" in address}
    return next((kind for kind, yes in named.items() if yes), "openai")


def request(model: str, base_url: str, prompt: str, system: str = "", backend: str | None = None, chat: bool = True, temperature: float = 0.0, stream: bool = False, thinking: bool = False, extra: dict | None = None, **options) -> tuple[str, dict]:
    """URL and payload of a call. Options: max_tokens, seed, top_p, stop, response_format; None means not sent."""
    if not model or not base_url:
        raise ConfigError("model and base_url are needed")
    kind, base = backend_of(model, base_url, backend), clean_base_url(base_url)
    unknown = set(options) - set(OPTION_NAMES["openai"])
    if unknown:
        raise ConfigError(f"unknown options {sorted(unknown)}")
    given = {k: v for k, v in options.items() if v not in (None, [])}
    body: dict = {"model": model.removeprefix(f"{kind}/"), "stream": stream}
    if kind == "ollama":
        asked = given.pop("response_format", None) or {}
        body |= {"prompt": prompt, "system": system, "options": {"temperature": temperature} | {OPTION_NAMES["ollama"][k]: v for k, v in given.items()} | ({} if thinking else {"think": False})}
        schema = (asked.get("json_schema") or {}).get("schema")
        if asked.get("type") == "json_object":
            body["format"] = "json"
        elif schema is not None:
            body["format"] = schema
        url = f"{base}/api/generate"
    else:
        spoken = [{"role": "system", "content": system}, {"role": "user", "content": prompt}]
        body |= {"temperature": temperature} | given | ({"messages": spoken} if chat else {"prompt": "\n\n".join(filter(None, (system, prompt)))})
        if kind == "llamacpp":
            body |= {"cache_prompt": True} | ({} if thinking or not chat else {"thinking": False, "chat_template_kwargs": {"enable_thinking": False}})
        url = f"{base}/v1/{'chat/' if chat else ''}completions"
    for name, value in (extra or {}).items():
        body[name] = body[name] | value if name == "options" and isinstance(body.get(name), dict) and isinstance(value, dict) else value
    return url, body


def answer_of(data: dict, backend: str, chat: bool = True) -> Answer:
    """What a server's JSON says; EmptyAnswer without content."""
    if backend == "ollama":
        found = Answer(data.get("response") or "", data.get("done_reason"), data.get("prompt_eval_count"), data.get("eval_count"))
        if not found.text and data.get("error"):
            raise RuntimeError(data["error"])
    else:
        choice, usage = next(iter(data.get("choices") or []), None) or {}, data.get("usage") or {}
        said = choice.get("message") or {}
        text = (said.get("content") or (said.get("reasoning_content") or "").strip()) if chat else choice.get("text")
        found = Answer(text or "", choice.get("finish_reason"), usage.get("prompt_tokens"), usage.get("completion_tokens"))
    if not found.text:
        raise EmptyAnswer("no content")
    return found


def is_retryable(error: BaseException, on_empty: bool = True) -> bool:
    """Is another attempt worth it: by the kind of error, never by its text."""
    if isinstance(error, HTTPFailure):
        return error.status == 429 or error.status // 100 == 5
    if isinstance(error, EmptyAnswer):
        return on_empty
    return isinstance(error, ConnectionError | TimeoutError | RuntimeError)


def delay(attempt: int, base: float, spread: float) -> float:
    """Seconds to wait after an attempt (from 1): doubling, times 0.5 to 1.5 as ``spread`` (0 to 1) tells."""
    return base * 2 ** (attempt - 1) * (0.5 + spread)


def with_retries(call: Callable[[], object], attempts: int = 3, base: float = 1.0, deadline: float | None = None, on_empty: bool = True, sleep=time.sleep, clock=time.monotonic, spread=random.random):
    """The result of ``call``, tried again while the error is worth it, attempts are left and the deadline is not reached."""
    began = clock()
    for attempt in range(1, attempts + 1):
        try:
            return call()
        except Exception as error:
            wait = delay(attempt, base, spread())
            late = deadline is not None and clock() - began + wait >= deadline
            if attempt == attempts or late or not is_retryable(error, on_empty):
                raise
            sleep(wait)
    raise ConfigError("no attempts")


def model(send: Callable[[str, dict], dict], model_name: str, base_url: str, system: str = "", attempts: int = 3, **options) -> Callable[[list[str]], list[str | None]]:
    """A scorer for ``tables.map_scored``: one call a prompt by ``send(url, payload)``; a call that fails for good gives None."""
    kind = backend_of(model_name, base_url, options.get("backend"))

    def score(prompts: list[str]) -> list[str | None]:
        out: list[str | None] = []
        for prompt in prompts:
            try:
                out.append(with_retries(lambda p=prompt: answer_of(send(*request(model_name, base_url, p, system, **options)), kind, options.get("chat", True)).text, attempts))
            except Exception:  # any failure of a remote model is a missing answer
                out.append(None)
        return out

    return score


_loaded: dict[int, tuple[object, object]] = {}


def _once(factory: Callable[[], object], fallback: Callable[[], object] | None) -> object:
    """What a factory makes, once a worker; the fallback's if it fails."""
    if id(factory) not in _loaded:
        try:
            made = factory()
        except Exception:
            if fallback is None:
                raise
            made = fallback()
        _loaded[id(factory)] = (factory, made)
    return _loaded[id(factory)][1]


def _column(df: DataFrame, text: str, out: str, kind: T.DataType, arrow: pa.DataType, factory, fallback, batch: int) -> DataFrame:
    """A column made from texts by what the factory gives: a function of a list of texts."""
    schema = T.StructType([*df.schema.fields, T.StructField(out, kind)])
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = _once(factory, fallback)
        for rows in batches:
            texts = rows.column(at).to_pylist()
            made = [x for i in range(0, len(texts), batch) for x in work([t or "" for t in texts[i : i + batch]])]
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(made, arrow)], names=schema.names)

    return df.mapInArrow(run, schema)


def embed(df: DataFrame, text: str, factory, out: str = "embedding", fallback=None, batch: int = 64) -> DataFrame:
    """``df`` with vectors by an encoder, a function of texts that ``factory()`` loads once a worker (or ``fallback()``); null texts count as empty."""
    return _column(df, text, out, T.ArrayType(T.DoubleType()), pa.list_(pa.float64()), factory, fallback, batch)


def count_tokens(df: DataFrame, text: str, factory, out: str = "tokens", fallback=None, batch: int = 256) -> DataFrame:
    """``df`` with token counts by a tokenizer, a function from texts to counts; by default where it can't be loaded, a quarter of the characters."""
    return _column(df, text, out, T.LongType(), pa.int64(), factory, fallback or (lambda: lambda texts: [len(t) // 4 for t in texts]), batch)


def hashing_encoder(size: int = 64) -> Callable[[], Callable[[Sequence[str]], list[list[float]]]]:
    """A factory of an encoder without a model: counts of words by a hash of the word; deterministic."""

    def factory():
        def encode(texts: Sequence[str]) -> list[list[float]]:
            out = []
            for text in texts:
                vector = [0.0] * size
                for word in text.lower().split():
                    h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "big")
                    vector[h % size] += 1.0 if h >> 63 else -1.0
                out.append(vector)
            return out

        return encode

    return factory


def tokenizer_file(path: str) -> Callable[[], Callable[[Sequence[str]], list[int]]]:
    """A factory of a token counter from a tokenizer's JSON file, which every executor must be able to read."""

    def factory():
        from tokenizers import Tokenizer

        own = Tokenizer.from_file(path)
        return lambda texts: [len(x.ids) for x in own.encode_batch(list(texts), add_special_tokens=False)]

    return factory


def fetch_pages(urls: DataFrame, fetch: Callable[[list[str]], list[dict]], url: str = "url", batch: int = 5, parallel: int = 3) -> DataFrame:
    """(url, success, html, error) of a column of URLs by ``fetch``, ``batch`` at a time in ``parallel`` tasks; a failing batch is not successful.

    A URL is fetched once; what a server does not answer for counts as failed.
    """
    schema = "url string, success boolean, html string, error string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            wanted = rows.column(0).to_pylist()
            for i in range(0, len(wanted), batch):
                own = wanted[i : i + batch]
                try:
                    got = {x.get("url"): x for x in fetch(own)}
                    error = "no answer"
                except Exception as e:
                    got, error = {}, type(e).__name__
                told = [got.get(u, {}) for u in own]
                ok = [x.get("success") is True for x in told]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(own, pa.string()), pa.array(ok, pa.bool_()), pa.array([x.get("html") if y else None for x, y in zip(told, ok, strict=True)], pa.string()), pa.array([None if y else x.get("error") or error for x, y in zip(told, ok, strict=True)], pa.string())],
                    names=["url", "success", "html", "error"],
                )

    return urls.select(F.col(url).alias("url")).where("url is not null").distinct().repartition(parallel).mapInArrow(run, schema)


def probe_images(media: DataFrame, head: Callable[[str], tuple[int, str]], url: str = "url", parallel: int = 10) -> DataFrame:
    """``media`` whose URLs answer 200 with an image type; ``head(url)`` gives status and content type."""
    at = media.columns.index(url)
    schema = media.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            good = []
            for u in rows.column(at).to_pylist():
                try:
                    status, kind = head(u)
                    good.append(status == 200 and (kind or "").lower().startswith("image/"))
                except Exception:
                    good.append(False)
            yield rows.filter(pa.array(good, pa.bool_()))

    return media.repartition(parallel).mapInArrow(run, schema)
