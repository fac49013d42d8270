"""Plug-in points: decision engines, splitters by format, extractors by type, batched calls."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ravelin.functions import passages
from ravelin.functions.answers import ANSWER_TYPE, build_answer
from ravelin.functions.binding import let

#: Default lexicon of the engine: subject and the words that point to it, in order of precedence. A parameter of ``ask``.
LEXICON = {
    "oversight": r"\baudit\w*|\bcontr[oô]le\w*", "money": r"\bbudget\w*|\bfacture\w*", "service": r"\brunbook\w*|\bconnecteur\w*",
    "reach": r"\bmobile\b|\bacc[eè]s\w*", "records": r"\bdoublon\w*|\barchive\w*",
}

Engine = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]


def lexicon_answer(text: Column, lexicon: dict[str, str] | None = None) -> Column:
    """Default engine as columns: first subject of the lexicon, with the share of hits as its probability."""
    words = (lexicon or LEXICON).items()

    def counted(low: Column) -> Column:
        counts = F.array(*[F.struct(F.lit(s).alias("s"), F.size(F.regexp_extract_all(low, F.lit(p), F.lit(0))).alias("n")) for s, p in words])
        return F.filter(counts, lambda c: c["n"] > 0)

    def answer(hits: Column) -> Column:
        total = F.aggregate(hits, F.lit(0), lambda t, c: t + c["n"])
        found = F.map_from_entries(F.transform(hits, lambda c: F.struct(c["s"], c["n"] / total)))
        probabilities = F.when(F.size(hits) > 0, found).otherwise(F.create_map(F.lit("noise"), F.lit(1.0)))
        return let(probabilities, lambda p: build_answer(F.lit("choice"), F.coalesce(F.get(hits, 0)["s"], F.lit("noise")), p, "lexicon"))

    return let(let(F.lower(text), counted), answer)


def ask(df: DataFrame, engine: Engine | None = None, identifier: str = "id", text: str = "text", lexicon: dict[str, str] | None = None) -> DataFrame:
    """Typed answer per row, by the lexicon or by an engine that maps pandas batches to (id, answer as JSON)."""
    if engine is None:
        return df.select(identifier, lexicon_answer(F.col(text), lexicon).alias("answer"))
    kind = df.schema[identifier].dataType.simpleString()
    raw = df.select(identifier, text).mapInPandas(engine, f"{identifier} {kind}, answer string")
    return raw.withColumn("answer", F.from_json("answer", ANSWER_TYPE))


PASSAGES = "array<struct<locator:string,text:string>>"


def _numbered(items: Column, prefix: str) -> Column:
    named = F.transform(items, lambda x, i: F.struct(F.concat(F.lit(prefix), (i + 1).cast("string")).alias("locator"), F.trim(x).alias("text")))
    return F.filter(named, lambda p: p["text"] != "")


# format -> function of the raw text, giving located passages
SPLITTERS: dict[str, Callable[[Column], Column]] = {
    "txt": lambda raw: _numbered(passages.lines_of(raw), "L"),
    "md": lambda raw: _numbered(passages.lines_of(raw), "L"),
    "csv": lambda raw: _numbered(F.slice(passages.lines_of(raw), F.lit(2), F.greatest(F.size(passages.lines_of(raw)) - 1, F.lit(0))), "R"),
    "eml": lambda raw: _numbered(F.split(raw, r"\n\s*\n"), "b"),
}


def split_by_format(df: DataFrame, fmt: str, raw: str) -> DataFrame:
    """Located passages of each row by the splitter of its format; unknown formats give none."""
    found = F.array().cast(PASSAGES)
    for name, splitter in SPLITTERS.items():
        found = F.when(F.col(fmt) == name, splitter(F.col(raw))).otherwise(found)
    return df.withColumn("_p", F.explode(found)).select(*[c for c in df.columns if c != raw], "_p.locator", "_p.text")


def run_extractors(df: DataFrame, registry: dict[str, Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """Items of every extractor, stacked."""
    out = None
    for name, extract in registry.items():
        part = extract(df).withColumn("element_type", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


class Retryable(RuntimeError):
    """A call that may work when repeated."""


def call_batches(
    df: DataFrame, client: Callable[[list[str]], list[str]], identifier: str, text: str, batch: int = 5, attempts: int = 4, pause: float = 0.0
) -> DataFrame:
    """Call an external service with small batches of texts.

    A failed call is repeated with a growing pause. An answer must be a JSON list of words of the text; an
    answer that is no JSON or names words the text lacks is asked again once, and the better one is kept.
    Counters come back as columns.
    """
    kind = df.schema[identifier].dataType.simpleString()

    def send(texts: list[str]) -> list[str]:
        for k in range(attempts):
            try:
                return client(texts)
            except Retryable:
                if k == attempts - 1:
                    raise
                time.sleep(pause * 2**k)
        return []

    def judge(raw: str, body: str) -> tuple[list[str] | None, int]:
        try:
            words = json.loads(raw)
        except ValueError:
            return None, 0
        if not isinstance(words, list) or not all(isinstance(w, str) for w in words):
            return None, 0
        return words, sum(w not in body for w in words)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for start in range(0, len(pdf), batch):
                rows = pdf.iloc[start : start + batch]
                for key, body, raw in zip(rows[identifier], rows[text], send(list(rows[text]))):
                    words, loose = judge(raw, body)
                    first, retried = words is not None, words is None or loose > 0
                    if retried:
                        again, loose2 = judge(send([body])[0], body)
                        if again is not None and (words is None or loose2 < loose):
                            words, loose = again, loose2
                    out.append((key, int(first), int(retried), int(words is None), int(loose), len(words or [])))
            yield pd.DataFrame(out, columns=[identifier, "valid_first", "retried", "failed", "ungrounded", "n_values"])

    return df.select(identifier, text).mapInPandas(
        run, f"{identifier} {kind}, valid_first int, retried int, failed int, ungrounded int, n_values int"
    )
