"""What a language model may steer: filters from a question, an answer from results, and a search in several turns.

The model is a callable of the user; limits and checks are here. Rows that reach the driver are pages of results.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scoring, text
from ..operators import filters, hierarchy
from . import search

LEAST_CONFIDENCE = 0.7
ANSWER_TOKENS = 8000
MOST_TURNS = 15
MOST_NUDGES = 3
STAGNATION = 4
#: A return with fewer collected rows than FEW, of more seen ones than MANY, is questioned once.
FEW, MANY = 20, 100
NOTE_TOKENS = 16_000


def interpreted(query: str, model: Callable[[str], tuple[list[filters.Condition], float]], sources: Sequence[str] = ()) -> list[list[filters.Condition]]:
    """Filter groups that a model reads from a question: none if it is not sure enough; conditions on unknown fields, or that
    do not hold up, are left out; source names take the spelling of the known ones."""
    conditions, confidence = model(query)
    if confidence < LEAST_CONFIDENCE:
        return []
    spelled = {s.lower(): s for s in sources}
    kept = []
    for c in conditions:
        if c.field == "source_name":
            names = c.value if isinstance(c.value, list) else [c.value]
            names = [spelled.get(str(v).lower(), v) for v in names]
            c = filters.Condition(c.field, c.operator, names if isinstance(c.value, list) else names[0])
        try:
            filters.condition(c)
        except ValueError:
            continue
        kept.append(c)
    return [kept] if kept else []


def answer(query: str, rows: DataFrame, model: Callable[[str, list[str]], str], budget: int = ANSWER_TOKENS, column: str = "textual_representation") -> str:
    """A model's answer from the best rows (score, entity_id), as many as fit the budget of tokens, the first in any case."""
    sized = scoring.ranked(rows, "score", "entity_id", search.MOST_RESULTS).withColumn("_size", F.size(text.tokens(F.coalesce(column, F.lit("")))))
    fit = scoring.within_budget(sized, "_size", ["rank"], budget, at_least=1).orderBy("rank")
    return model(query, [r[0] for r in fit.select(column).collect()])


@dataclass
class State:
    """What a search in turns has seen and collected."""

    seen: dict[str, float] = field(default_factory=dict)
    collected: list[str] = field(default_factory=list)
    notes: list[str] = field(default_factory=list)
    turns: int = 0
    nudges: int = 0
    questioned: bool = False


@dataclass
class Act:
    """A turn of the model: `search` (a plan), `read` (ids), `add` or `remove` (ids or "all"), `return`."""

    tool: str
    argument: object = None


def converse(index: DataFrame, model: Callable[[str, State], Act | None], query: str, stores: search.Stores | None = None, column: str = "textual_representation") -> DataFrame:
    """(entity_id, rank) of the rows collected in at most MOST_TURNS turns, best scores first.

    A model that calls no tool is reminded, and stopped after MOST_NUDGES such turns; one that collects nothing for STAGNATION
    turns is told so. Notes hold the newest results that fit NOTE_TOKENS.
    """
    state, since, silent = State(), 0, 0
    for state.turns in range(1, MOST_TURNS + 1):
        act = model(query, state)
        if act is None:
            silent += 1
            if silent >= MOST_NUDGES:
                break
            state.notes.append("Use a tool: search, read, add, remove or return.")
            continue
        silent, before = 0, len(state.collected)
        if act.tool == "search":
            found = search.run(act.argument, index, stores=stores).collect()
            for r in found:
                state.seen[r["entity_id"]] = max(r["score"], state.seen.get(r["entity_id"], r["score"]))
            state.notes.append("found " + ", ".join(r["entity_id"] for r in found))
        elif act.tool == "read":
            matched = index.where(F.col("entity_id").isin(list(act.argument)))
            near = hierarchy.surrounding(index, matched).orderBy("original_entity_id", "chunk_index").limit(hierarchy.MOST)
            state.notes += [r[0] or "" for r in near.select(column).collect()]
        elif act.tool in ("add", "remove"):
            ids = (list(state.seen) if act.tool == "add" else list(state.collected)) if act.argument == "all" else list(act.argument)
            if act.tool == "add":
                state.collected += [i for i in dict.fromkeys(ids) if i in state.seen and i not in state.collected]
            else:
                state.collected = [i for i in state.collected if i not in ids]
        elif act.tool == "return":
            if len(state.collected) < FEW and len(state.seen) > MANY and not state.questioned:
                state.questioned = True
                state.notes.append(f"Only {len(state.collected)} of {len(state.seen)} results are collected. Return again to end.")
                continue
            break
        else:
            raise ValueError(f"unknown tool {act.tool}")
        since = 0 if len(state.collected) > before else since + 1
        if since >= STAGNATION:
            state.nudges += 1
            state.notes.append("Nothing new has been collected for some turns: collect or return.")
        state.notes = _newest(state.notes, NOTE_TOKENS)
    ordered = sorted(state.collected, key=lambda i: (-state.seen[i], i))
    return index.sparkSession.createDataFrame([(i, k + 1) for k, i in enumerate(ordered)], "entity_id string, rank int")


def _newest(notes: list[str], budget: int) -> list[str]:
    """The newest notes that fit the budget of tokens; the newest one in any case."""
    kept, used = [], 0
    for note in reversed(notes):
        used += len(note.split())
        if kept and used > budget:
            break
        kept.append(note)
    return kept[::-1]
