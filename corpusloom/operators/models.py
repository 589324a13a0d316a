"""The model surface: an injected text generator, and what surrounds it.

A model is an object with `generate(list[str]) -> list[str]`. The ones here
are deterministic stand-ins; a real one is passed in by the caller and loaded
once in each Python worker.
"""

from __future__ import annotations

import hashlib
import json
import random
import re
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Model(Protocol):
    def generate(self, prompts: list[str]) -> list[str]: ...


class Scripted:
    """Answers in the order given; the last one again when they are used up."""

    def __init__(self, *answers: str):
        self.answers, self.prompts = list(answers), []

    def generate(self, prompts: list[str]) -> list[str]:
        self.prompts += prompts
        return [self.answers.pop(0) if len(self.answers) > 1 else self.answers[0] for _ in prompts]


class LengthJudge:
    """KEEP for short items, REJECT for long ones, by the numbered lines of a prompt."""

    def __init__(self, limit: int):
        self.limit = limit

    def generate(self, prompts: list[str]) -> list[str]:
        return ["\n".join(f"{n}. {'KEEP' if len(t) <= self.limit else 'REJECT'}" for n, t in re.findall(r"^(\d+)\. (.*)$", p, re.M)) for p in prompts]


def numbered(texts: list[str]) -> str:
    return "\n".join(f"{i}. {' '.join(t.split())}" for i, t in enumerate(texts, 1))


def verdicts(answer: str, n: int) -> list[bool]:
    """Kept or not by number; a line that is missing or garbled keeps."""
    said = {int(i): word.upper() for i, word in re.findall(r"^\s*(\d+)[.):]\s*(KEEP|REJECT)\b", answer, re.M | re.I)}
    return [said.get(i, "KEEP") != "REJECT" for i in range(1, n + 1)]


def validated(rows: DataFrame, key: str, text: str, model: Model, batch: int = 15) -> DataFrame:
    """(key, kept): a model's verdicts in batches of `batch`; if it fails, all of the batch are kept."""

    def judge(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            kept: list[bool] = []
            for i in range(0, len(part), batch):
                texts = part[text].iloc[i : i + batch].fillna("").tolist()
                try:
                    answer = model.generate([numbered(texts)])[0]
                except Exception:  # a failing model rejects nothing
                    answer = ""
                kept += verdicts(answer, len(texts))
            yield pd.DataFrame({key: part[key].to_numpy(), "kept": kept})

    kind = dict(rows.dtypes)[key]
    return rows.select(key, text).mapInPandas(judge, f"{key} {kind}, kept boolean")


def chosen_concept(answer: str, candidates: list[str]) -> tuple[str | None, str]:
    """(id, status) of a disambiguation answer; an id that isn't a candidate is no match."""
    found = re.search(r"\bC\d{7}\b", answer or "")
    if found and found[0] in candidates:
        return found[0], "disambiguated"
    return None, "no_match_after_llm"


def json_span(answer: str, opening: str = "[") -> object | None:
    """The first to the last bracket of an answer, read as JSON; None if it can't be."""
    closing = "]" if opening == "[" else "}"
    text = re.sub(r"(?s)<think>.*?</think>", "", answer or "")
    a, b = text.find(opening), text.rfind(closing)
    try:
        return json.loads(text[a : b + 1]) if 0 <= a < b else None
    except ValueError:
        return None


def relations(answer: str, allowed: tuple[str, ...]) -> list[dict]:
    """The items of an answer with all fields and an allowed relation."""
    fields = ("subject", "subject_type", "relation", "object", "object_type")
    items = json_span(answer)
    return [{f: str(x[f]).strip() for f in fields} for x in items if isinstance(x, dict) and all(x.get(f) for f in fields) and x["relation"] in allowed] if isinstance(items, list) else []


def cache_key(prompt: str, system: str = "", **sampling) -> str:
    return hashlib.sha256(json.dumps([prompt, system, sampling], sort_keys=True).encode()).hexdigest()


def answered(prompts: DataFrame, prompt: str, cache: DataFrame, model: Model, system: str = "", **sampling) -> DataFrame:
    """(key, answer): the cache's last answer of a `cache_key`, and the model's for prompts that have none."""

    @F.pandas_udf("string")
    def key_of(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: cache_key(t or "", system, **sampling))

    keyed = prompts.select(prompt).distinct().withColumn("key", key_of(F.col(prompt))).dropDuplicates(["key"])
    known = cache.groupBy("key").agg(F.max_by("answer", "line_no").alias("answer"))

    def ask(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame({"key": part["key"], "answer": model.generate(part[prompt].tolist())})

    new = keyed.join(known, "key", "left_anti").mapInPandas(ask, "key string, answer string")
    return keyed.join(known, "key").select("key", "answer").unionByName(new)


def tournament(scored: list[tuple], size: int, seed: int) -> list:
    """One winner a slot: the best of `size` entrants drawn without return."""
    rng = random.Random(seed)
    return [max(rng.sample(scored, min(size, len(scored))), key=lambda c: c[1])[0] for _ in scored]


def search(start: list[str], score: Callable[[str], float], cross: Callable[[str, str], str], mutate: Callable[[str], str], generations: int, rate: float = 0.1, size: int = 3, seed: int = 42) -> tuple[str, float, list[float]]:
    """Prompt search: (best prompt, its score, best score of each generation).

    Selection by tournament, two children of each pair, some mutated, the best
    so far in the first child's place. A text is scored once.
    """
    if len(start) < 2 or len(start) % 2:
        raise ValueError("an even number of prompts is needed, two at least")
    rng, known = random.Random(seed), {}

    def value(p: str) -> float:
        if p not in known:
            known[p] = score(p)
        return known[p]

    population, log = list(start), [max(map(value, start))]
    for g in range(generations):
        best = max(population, key=value)
        parents = tournament([(p, value(p)) for p in population], size, rng.randrange(1 << 30))
        children = [cross(a, b) for i in range(0, len(parents), 2) for a, b in ((parents[i], parents[i + 1]), (parents[i + 1], parents[i]))]
        children = [mutate(c) if rng.random() < rate else c for c in children]
        population = [best, *children[1:]]
        log.append(max(map(value, population)))
    best = max(population, key=value)
    return best, value(best), log


def planned_calls(population: int, generations: int, validation: int, test: int, test_prompts: int = 2) -> int:
    """Calls of the target model in a whole run: the elite keeps its score."""
    return validation + population * validation + generations * (population - 1) * validation + test_prompts * test
