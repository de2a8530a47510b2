"""Optional opinions of a language model on changed passages and ambiguous sections.

The model is any function that the caller passes; nothing here reaches a network. Texts are data: answers
on unknown ids, or with unknown candidates, are dropped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BATCH, PASSAGE, PASSAGES_PER_CASE = 8, 1400, 6


def clipped(text: Column, limit: int = PASSAGE) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit(" […]"))).otherwise(text)


def unit_interval(x: Column, default: float = 0.6) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(x, F.lit(default))))


def analyze(candidates: DataFrame, ask: Callable[[list[dict]], list[dict]], batch: int = BATCH) -> DataFrame:
    """Answers on ``candidates`` (cmp_id, n_a, n_b, text_a, text_b): meaning_changed, category, summary, confidence.

    ``ask`` takes up to ``batch`` passages with an ``id`` and returns answers with that id; a batch that
    fails is skipped and its passages have no answer.
    """
    rows = candidates.select("cmp_id", "n_a", "n_b", clipped(F.col("text_a")).alias("text_a"), clipped(F.col("text_b")).alias("text_b"))

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), batch):
                part = frame.iloc[at : at + batch]
                ids = {f"p{k}": k for k in range(len(part))}
                asked = [{"id": i, "before": part["text_a"].iloc[k], "after": part["text_b"].iloc[k]} for i, k in ids.items()]
                try:
                    answers = ask(asked)
                except Exception:  # the provider's own errors are of any kind; a batch without an answer changes nothing
                    continue
                for x in answers:
                    if x.get("id") in ids:
                        row = part.iloc[ids[x["id"]]]
                        yield pd.DataFrame([[row["cmp_id"], row["n_a"], row["n_b"], bool(x.get("meaning_changed")), x.get("category"), x.get("summary"), x.get("confidence")]], columns=["cmp_id", "n_a", "n_b", "meaning_changed", "category", "summary", "confidence"])

    kind = candidates.schema["cmp_id"].dataType.simpleString()
    out = rows.mapInPandas(run, f"cmp_id {kind}, n_a int, n_b int, meaning_changed boolean, category string, summary string, confidence double")
    return out.withColumn("confidence", unit_interval(F.col("confidence")))


def arbitrate(cases: DataFrame, ask: Callable[[list[dict]], list[dict]]) -> DataFrame:
    """Choices (cmp_id, section_id_a, choice) of a model on ``cases``.

    ``cases``: ``align.ambiguous`` with ``excerpt_a``, ``excerpt_b`` and ``rival_excerpt``. A comparison's few
    cases are asked at once, each with its match and its rivals by their ids; ``ask`` answers with ``id`` and
    ``choice``. Only ids that were offered, or null, count; a comparison whose call fails keeps its matches.
    """
    kind = cases.schema["cmp_id"].dataType.simpleString()

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        asked, offered = [], {}
        for (case, a), rows in frame.sort_values(["case", "rank"]).groupby(["case", "section_id_a"], sort=True):
            first = rows.iloc[0]
            choices = {first["section_id_b"]: first["excerpt_b"]} | dict(zip(rows["rival"], rows["rival_excerpt"]))
            offered[f"c{case}"] = a, set(choices)
            asked.append({"id": f"c{case}", "section": first["excerpt_a"], "choices": choices})
        try:
            answers = ask(asked)
        except Exception:  # the provider's own errors are of any kind
            answers = []
        good = [x for x in answers if x.get("id") in offered and (x.get("choice") is None or x["choice"] in offered[x["id"]][1])]
        return pd.DataFrame([(frame["cmp_id"].iloc[0], offered[x["id"]][0], x.get("choice")) for x in good], columns=["cmp_id", "section_id_a", "choice"])

    return cases.groupBy("cmp_id").applyInPandas(run, f"cmp_id {kind}, section_id_a string, choice string")


def allowed(choices: DataFrame, cases: DataFrame) -> DataFrame:
    """Choices (cmp_id, section_id_a, choice) on known cases; a choice must be null, the match or a rival."""
    known = cases.groupBy("cmp_id", "section_id_a").agg(F.array_union(F.collect_set("section_id_b"), F.collect_set("rival")).alias("known"))
    return choices.join(known, ["cmp_id", "section_id_a"]).where("choice is null or array_contains(known, choice)").drop("known")


def loose_json(text: Column, schema: str) -> Column:
    """JSON in a model's reply: the whole of it, a fenced block, or the widest span in brackets."""
    whole = F.from_json(text, schema)
    fenced = F.from_json(F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)```", 1), schema)
    widest = F.from_json(F.regexp_extract(text, r"(?s)([\[{].*[\]}])", 1), schema)
    is_json = lambda t: F.try_parse_json(t).isNotNull()
    return F.when(is_json(text), whole).when(is_json(F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)```", 1)), fenced).otherwise(widest)
