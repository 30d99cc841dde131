"""Extraction with an exchangeable backend: ask, parse, check, ask again with the error; results and errors apart."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from pathlib import Path
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataline.operators.schema import json_schema, validate
from strataline.session import cut
from strataline.sources import files

#: Further asks after the first.
MAX_RETRIES = 2


class Extractor(Protocol):
    """A backend: ``ask`` takes the parts sent so far and gives (text, input tokens, output tokens)."""

    def ask(self, parts: list[str]) -> tuple[str, int, int]: ...


class OfflineExtractor:
    """A deterministic stand-in: answers broken JSON ``fail`` times, then an object with the text's length."""

    def __init__(self, fail: int = 0):
        self.fail = fail

    def ask(self, parts: list[str]) -> tuple[str, int, int]:
        asks = sum(p.startswith("error:") for p in parts)
        body = json.dumps({"chars": len(parts[0]), "asks": asks + 1})
        return ("{broken" if asks < self.fail else body), sum(map(len, parts)), len(body)


# Models by name, as (kind of service, model; None for the service's own choice).
MODELS = {
    "gemini": ("gemini", None), "gemini-3-flash": ("gemini", "gemini-3-flash-preview"), "gemini-3.1-pro": ("gemini", "gemini-3.1-pro-preview"),
    "claude": ("claude", None), "gpt5.4": ("openai", None), "offline": ("offline", None),
}
#: kind of service -> maker of a backend from a model's name. Live services are not part of the package: whoever has
#: one registers it here, on the workers too (a module that is shipped to them).
BACKENDS: dict[str, Callable[[str | None], Extractor]] = {"offline": lambda model: OfflineExtractor()}


@lru_cache(maxsize=8)
def backend(name: str) -> Extractor:
    """The backend of a model; a worker makes it once and keeps it."""
    kind, model = MODELS[name]
    if kind not in BACKENDS:
        raise ValueError(f"no backend for {kind}: register one")
    return BACKENDS[kind](model)


@dataclass(frozen=True)
class Prompts:
    """Templates: ``text`` has {schema} and {text}, ``retry`` has {errors} and {schema}."""

    text: str = "{text}"
    retry: str = "error: {errors}"

    @staticmethod
    def load(folder: str, name: str = "simple_schemaless") -> Prompts:
        """Templates of a folder: text_prefix.txt before <name>.txt, and retry.txt; line breaks at their ends go."""
        read = lambda n: (Path(folder) / n).read_text(encoding="utf-8").rstrip("\n")
        return Prompts(read("text_prefix.txt") + "\n" + read(f"{name}.txt"), read("retry.txt"))


def fenced(text: str) -> str:
    """Worker-side twin of the fence expression."""
    if not text.startswith("```"):
        return text
    body = text.split("\n")[1:]
    end = next((i for i, x in enumerate(body) if x.startswith("```")), len(body))
    return "\n".join(body[:end])


def extract_one(extractor: Extractor, parts: list[str], required: list[str]) -> dict:
    """Result of one input: data, tokens over all asks, retries. Raises ValueError after the last ask.

    The first parts stay in every further ask; each error is added to them.
    """
    sent, used_in, used_out = list(parts), 0, 0
    for attempt in range(1 + MAX_RETRIES):
        text, i, o = extractor.ask(sent)
        used_in, used_out = used_in + i, used_out + o
        try:
            data = json.loads(fenced(text))
            lacking = [k for k in required if not isinstance(data, dict) or k not in data]
            if lacking:
                raise ValueError("missing: " + ", ".join(lacking))
            return {"data": json.dumps(data, ensure_ascii=False), "input_tokens": used_in, "output_tokens": used_out, "retry_count": attempt}
        except ValueError as e:
            if attempt == MAX_RETRIES:
                raise
            sent.append(f"error: {e}")
    raise AssertionError


def extract_checked(extractor: Extractor, text: str, schema: dict, prompts: Prompts) -> dict:
    """Result of one text whose answer must follow a schema. Every further ask has the first part as it was, the last
    answer and what is wrong with it. Tokens count over all asks; after the last, ValueError with ``tokens``."""
    told = json.dumps(schema, ensure_ascii=False, indent=2)
    base = [prompts.text.replace("{schema}", told).replace("{text}", text)]
    sent, used = base, [0, 0]
    for attempt in range(1 + MAX_RETRIES):
        answer, i, o = extractor.ask(sent)
        used = [used[0] + i, used[1] + o]
        try:
            data = json.loads(fenced(answer))
            validate(data, schema)
            return {"data": json.dumps(data, ensure_ascii=False), "input_tokens": used[0], "output_tokens": used[1], "retry_count": attempt}
        except ValueError as e:
            if attempt == MAX_RETRIES:
                e.tokens = tuple(used)
                raise
            sent = [*base, "Previous invalid JSON response:", answer, prompts.retry.replace("{errors}", str(e)).replace("{schema}", told)]
    raise AssertionError


_RESULT = "file string, data string, input_tokens long, output_tokens long, retry_count int, elapsed_seconds double, error string"


def extract(inputs: DataFrame, make: Callable[[str], Extractor] | str, required: list[str] | None = None, prompts: Prompts | None = None) -> DataFrame:
    """(file, data, input_tokens, output_tokens, retry_count, elapsed_seconds, error) for (file, text[, record]).

    ``make``: a model's name, or a function of the file. With a column ``record`` (JSON of the file's truth) answers
    must follow its schema, and a file without record is an error; else they must have the ``required`` keys.
    ``error`` is null on success; an input that fails tells the tokens it cost all the same. A task may run twice;
    write results by file so that a second run replaces the first.
    """
    checked = "record" in inputs.columns

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in it:
            out = []
            for f, t, record in zip(b["file"], b["text"], b["record"] if checked else [None] * len(b), strict=True):
                began = time.monotonic()
                try:
                    e = backend(make) if isinstance(make, str) else make(f)
                    if checked:
                        if record is None:
                            raise FileNotFoundError(f"no record of {f}")
                        r = extract_checked(e, t or "", json_schema(json.loads(record)), prompts or Prompts())
                    else:
                        r = extract_one(e, [t or ""], required or [])
                    out.append((f, r["data"], r["input_tokens"], r["output_tokens"], r["retry_count"], time.monotonic() - began, None))
                except Exception as x:  # noqa: BLE001 - any failure of a backend belongs in the error log
                    out.append((f, None, *getattr(x, "tokens", (0, 0)), MAX_RETRIES, time.monotonic() - began, str(x)))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in _RESULT.split(", ")])

    return inputs.select("file", "text", *["record"] * checked).mapInPandas(run, _RESULT)


def run_extraction(inputs: DataFrame, root: str, llm: str, parse_type: str, make: Callable[[str], Extractor] | str | None = None, prompts: Prompts | None = None, prompt: str = "simple_schemaless") -> DataFrame:
    """Extract (file, text, record), keep results and errors under ``root``, give one row of totals.

    Results are <output folder>/<file>.json with ``_metadata`` first; errors are appended as JSON lines (file, error)
    to errors_<llm>/<folder>. Totals: files, failed, input_tokens, output_tokens, elapsed_seconds, the sums over
    successes only.
    """
    done = cut(extract(inputs, make or llm, prompts=prompts))
    folder = files.output_dir("", parse_type, llm, prompt).lstrip("/")
    ok, bad = done.where("error is null"), done.where("error is not null")
    head = F.concat(F.lit('{"_metadata": {"retry_count": '), F.col("retry_count").cast("string"), F.lit("}"))
    body = F.when(F.col("data").rlike(r"^\{\s*\}$"), F.lit("}")).otherwise(F.concat(F.lit(", "), F.regexp_replace("data", r"^\{", "")))
    files.write_files(ok.where(F.col("data").startswith("{")).select(F.concat(F.lit(f"{folder}/"), "file", F.lit(".json")).alias("path"), F.concat(head, body).alias("content")), root)
    files.write_json(bad.select("file", "error"), f"{root}/{folder.replace('results_', 'errors_', 1)}", append=True)
    good = lambda c: F.coalesce(F.sum(F.when(F.col("error").isNull(), F.col(c))), F.lit(0))
    return done.agg(F.count_if(F.col("error").isNull()).alias("files"), F.count("error").alias("failed"), *[good(c).alias(c) for c in ("input_tokens", "output_tokens", "elapsed_seconds")])
