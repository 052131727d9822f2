"""Multi-turn facility conversations.

What a turn means depends on the state left by earlier turns, and the state only
changes when a turn finds strong candidates. The fold carries the slots alone;
parsing before it and the search after it are joins over all turns at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.operators import facilities as FC
from citeloom.session import staged

RESET = "/reset"
RESOLVED = (
    "conv_id string, turn long, query_text string, outcome string, prefecture string, city string, "
    "service_type string, keywords array<string>, contact_requested boolean"
)
_COLUMNS = [part.split()[0] for part in RESOLVED.split(", ")]
#: What the fold reads for each turn.
TURN_COLUMNS = [
    "conv_id", "turn", "query_text", "prefecture", "city", "service_type", "service_known", "names_facility",
    "keywords", "contact_requested",
]


@dataclass
class Slots:
    """State of one conversation."""

    prefecture: str | None = None
    city: str | None = None
    service_type: str | None = None
    service_known: bool = False
    keywords: list[str] = field(default_factory=list)


@dataclass(frozen=True)
class Coverage:
    """Keyword pairs that some facility has, and keywords found in each prefecture.

    At most 105 pairs and 15 keywords per prefecture, whatever the number of facilities.
    """

    pairs: frozenset
    local: frozenset


def coverage(facilities: DataFrame) -> Coverage:
    # facilities that agree on prefecture and keywords count once
    kinds = staged(FC.dealt_blobs(facilities, "facility_id", "ordinal", "prefecture").select("prefecture", FC.keyword_mask().alias("mask")).distinct())
    words = F.array_compact(F.array(*[F.when(F.col("mask").bitwiseAND(F.lit(1 << i)) != 0, w) for i, w in enumerate(FC.FEATURE_KEYWORDS)]))
    rows = kinds.select("prefecture", words.alias("words"))
    first = rows.select("words", F.explode("words").alias("a"))
    pairs = first.select("a", F.explode("words").alias("b")).filter("a < b").distinct()
    local = rows.select("prefecture", F.explode("words").alias("a")).distinct()
    return Coverage(
        frozenset((r["a"], r["b"]) for r in pairs.collect()), frozenset((r["prefecture"], r["a"]) for r in local.collect())
    )


def _is_strong(slots: Slots, names_facility: bool, cover: Coverage) -> bool:
    """Whether any facility can reach the strong score for these slots."""
    if slots.city or (slots.service_type and slots.service_known) or names_facility:
        return True
    words = slots.keywords
    if any((a, b) in cover.pairs for a in words for b in words if a < b):
        return True
    return any((slots.prefecture, w) in cover.local for w in words)


def advance(state: Slots, turn: dict, cover: Coverage) -> tuple[Slots, dict]:
    """Next state and resolved turn."""
    out = {"conv_id": turn["conv_id"], "turn": turn["turn"], "query_text": turn["query_text"]}
    if (turn["query_text"] or "").strip() == RESET:
        return Slots(), out | {"outcome": "reset", "keywords": [], "contact_requested": False}
    merged = Slots(
        turn["prefecture"] or state.prefecture,
        turn["city"] or state.city,
        turn["service_type"] or state.service_type,
        bool(turn["service_known"]) if turn["service_type"] else state.service_known,
        sorted({*state.keywords, *turn["keywords"]}),
    )
    if not (merged.city or merged.service_type or merged.keywords):
        outcome = "clarify"
    elif _is_strong(merged, bool(turn["names_facility"]), cover):
        outcome, state = "answer", merged
    else:
        outcome = "unknown"
    return state, out | {
        "outcome": outcome,
        "prefecture": merged.prefecture,
        "city": merged.city,
        "service_type": merged.service_type,
        "keywords": merged.keywords,
        "contact_requested": bool(turn["contact_requested"]),
    }


def turn_records(pdf: pd.DataFrame) -> list[dict]:
    """Rows of a batch as plain values."""
    records = pdf.astype(object).where(pdf.notna(), None).to_dict("records")
    for row in records:
        row["keywords"] = list(row["keywords"] if row["keywords"] is not None else [])
    return records


def resolved_frame(rows: list[dict]) -> pd.DataFrame:
    # plain objects throughout: a column of missing values must not turn into floats
    return pd.DataFrame([[row.get(c) for c in _COLUMNS] for row in rows], columns=_COLUMNS, dtype=object)


def prepare_turns(turns: DataFrame, facilities: DataFrame) -> DataFrame:
    """Own slots of each turn of ``turns(conv_id, turn, query_text)``, ready for the fold."""
    asked = turns.withColumn("query_id", F.concat_ws(":", "conv_id", "turn"))
    own = FC.own_intent(asked, facilities)
    services = facilities.select("service_type").distinct().withColumn("service_known", F.lit(True))
    names = FC.substring_pairs(
        asked.select("query_id", "query_text"), facilities.select("name"), "query_id", "query_text", "name", []
    )
    named = names.select("query_id").distinct().withColumn("names_facility", F.lit(True))
    joined = own.join(services, "service_type", "left").join(named, "query_id", "left")
    return joined.select(*TURN_COLUMNS)


def fold_turns(prepared: DataFrame, cover: Coverage) -> DataFrame:
    """Resolve every turn in order: one shuffle by conversation, then a streaming fold."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        owner, state = None, Slots()
        for batch in batches:
            rows = []
            for turn in turn_records(batch):
                if turn["conv_id"] != owner:
                    owner, state = turn["conv_id"], Slots()
                state, resolved = advance(state, turn, cover)
                rows.append(resolved)
            if rows:
                yield resolved_frame(rows)

    ordered = prepared.repartition("conv_id").sortWithinPartitions("conv_id", "turn")
    return ordered.mapInPandas(run, RESOLVED)


def answer_turns(resolved: DataFrame, facilities: DataFrame, k: int = 3) -> tuple[DataFrame, DataFrame]:
    """Answer text of every resolved turn, and the candidates of the answered ones."""
    rows = resolved.withColumn("query_id", F.concat_ws(":", "conv_id", "turn"))
    intents = rows.filter("outcome = 'answer'")
    ranked = FC.strong_candidates(FC.rule_topk(intents, facilities, k))
    explained = FC.explain_candidates(ranked, intents, facilities)
    texts = rows.join(FC.render_answer(explained), "query_id", "left")
    answer = (
        F.when(F.col("outcome") == "clarify", FC.CLARIFY_TEXT)
        .when(F.col("outcome") == "unknown", FC.UNKNOWN_TEXT)
        .otherwise(F.col("answer"))
    )
    answers = texts.select("conv_id", "turn", "outcome", answer.alias("answer"))
    return answers, explained


def converse(turns: DataFrame, facilities: DataFrame, k: int = 3) -> tuple[DataFrame, DataFrame]:
    """Answers and candidates of whole conversations."""
    resolved = staged(fold_turns(prepare_turns(turns, facilities), coverage(facilities)))
    return answer_turns(resolved, facilities, k)
