"""Relation paths over a typed graph: what stands at the end of a path from each of many nodes, and cards that are told by such paths."""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knotwork.durable import Cuts


class Path:
    """What can be walked; `a / b` is one after the other, `a | b` either, `~a` backwards."""

    def __truediv__(self, other: Path) -> Path:
        return Sequence_((self, other))

    def __or__(self, other: Path) -> Path:
        return Choice((self, other))

    def __invert__(self) -> Path:
        return Back(self)


@dataclass(frozen=True)
class Rel(Path):
    """One edge of any of the relations."""

    names: tuple[str, ...]


@dataclass(frozen=True)
class Sequence_(Path):
    parts: tuple[Path, ...]


@dataclass(frozen=True)
class Choice(Path):
    parts: tuple[Path, ...]


@dataclass(frozen=True)
class Back(Path):
    of: Path


@dataclass(frozen=True)
class Times(Path):
    """A path from `least` to `most` times in a row; no times is where one stands."""

    of: Path
    least: int
    most: int


@dataclass(frozen=True)
class Only(Path):
    """Stays where it is, at nodes of the types."""

    types: tuple[str, ...]


def rel(*names: str) -> Path:
    return Rel(names)


def only(*types: str) -> Path:
    return Only(types)


def inverse(path: Path) -> Path:
    """The path walked backwards, with edges alone turned round."""
    match path:
        case Back(of):
            return plain(of)
        case Sequence_(parts):
            return Sequence_(tuple(inverse(p) for p in reversed(parts)))
        case Choice(parts):
            return Choice(tuple(inverse(p) for p in parts))
        case Times(of, least, most):
            return Times(inverse(of), least, most)
        case Only():
            return path
        case _:
            return Back(path)


def plain(path: Path) -> Path:
    """The same path with backwards pushed down to single edges."""
    match path:
        case Back(Rel()):
            return path
        case Back(of):
            return inverse(of)
        case Sequence_(parts):
            return Sequence_(tuple(plain(p) for p in parts))
        case Choice(parts):
            return Choice(tuple(plain(p) for p in parts))
        case Times(of, least, most):
            return Times(plain(of), least, most)
        case _:
            return path


def walk(front: DataFrame, edges: DataFrame, nodes: DataFrame, path: Path, cuts: Cuts | None = None) -> DataFrame:
    """front (start, id) with id moved along the path; each pair once.

    An edge is one join, on both ends of which rows are distinct; a repetition goes on from what is new only, so that cycles end. Ends
    that are no nodes are walked over like others, but have no type.
    """
    cuts = cuts or Cuts(front.sparkSession)
    return _walk(front.select("start", "id").where("id is not null").distinct(), edges, nodes, plain(path), cuts)


def _walk(front: DataFrame, edges: DataFrame, nodes: DataFrame, path: Path, cuts: Cuts) -> DataFrame:
    match path:
        case Rel(names) | Back(Rel(names)):
            here, there = ("target", "source") if isinstance(path, Back) else ("source", "target")
            step = edges.where(F.col("relation").isin(*names)).select(F.col(here).alias("id"), F.col(there).alias("_to"))
            return front.join(step, "id").select("start", F.col("_to").alias("id")).distinct()
        case Only(types):
            return front.join(nodes.where(F.col("type").isin(*types)).select("id"), "id", "left_semi").select("start", "id")
        case Sequence_(parts):
            return reduce(lambda f, p: _walk(f, edges, nodes, p, cuts), parts, front)
        case Choice(parts):
            return reduce(DataFrame.unionByName, [_walk(front, edges, nodes, p, cuts) for p in parts]).distinct()
        case Times(of, least, most):
            at = front
            for _ in range(least):
                at = _walk(at, edges, nodes, of, cuts)
            at = seen = cuts.table(at)
            for _ in range(most - least):
                at, n = cuts.counted(_walk(at, edges, nodes, of, cuts).join(seen, ["start", "id"], "left_anti"), uuid.uuid4().hex)
                if not n:
                    break
                seen = seen.unionByName(at)
            return seen
    raise TypeError(f"no path: {path!r}")


_HOLDS, _RUNS = rel("contains"), rel("calls", "invokes_workflow")
#: Facts of a card by who has it (layers, or types where they say more): name and path. Relations and types are fixed values.
PANEL = (("app", ~_HOLDS / only("app", "appPanel")), ("rendered by", rel("rendered_by")), ("panels within", _HOLDS))
ACTION = (("app", ~_HOLDS), ("leads to", rel("navigates_to")), ("starts", rel("invokes_agent")))
AGENT = (("tools", rel("uses_tool")), ("topics", rel("uses_topic")), ("started by", ~rel("invokes_agent_resource", "uses_agent")))
APP = (("agents", rel("exposes_agent")), ("panels", _HOLDS / only("appPanel")), ("actions", _HOLDS / only("appAction")), ("leads to", rel("navigates_to")), ("data", rel("depends_on_data")))
FLOW = (
    ("apps", ~rel("exposes_agent", "rendered_by", "summarized_by", "subtitle_by", "communicates_via", "invokes_agent")), ("callers", ~_RUNS), ("calls", _RUNS), ("data", rel("depends_on_data")), ("tools", rel("uses_tool")),
    ("models", rel("uses_model")), ("stages", rel("routes_app_stage")), ("steps", _HOLDS), ("all that it runs", Times(_RUNS, 1, 8)),
)
TOOL = (("functions", _HOLDS / only("boFunction")), ("users", ~rel("depends_on_data", "uses_tool", "uses_business_object")), ("steps that call it", ~rel("calls_bo_function")), ("resources", rel("exposes_rest_resource", "calls_rest")))
STEP = (("workflow", ~_HOLDS), ("next", rel("flows_to", "converges_to", "on_error_to")), ("before", ~rel("flows_to", "converges_to", "on_error_to")), ("reads", rel("reads_output_of")), ("functions", rel("calls_bo_function")), ("models", rel("uses_model")))
CARDS = {"appPanel": PANEL, "appSubPanel": PANEL, "appAction": ACTION, "agent": AGENT, "4": APP, "3": FLOW, "2": FLOW, "1": TOOL, "0": STEP}


def cards(nodes: DataFrame, edges: DataFrame, of: DataFrame | None = None, kinds: dict[str, tuple] = CARDS) -> DataFrame:
    """(id, fact, other, label) of the nodes, or of those of (id): what each fact of a node's card leads to. A node's card is that of its type, or else of its layer (column `layer`, if there is one)."""
    layer = F.col("layer").cast("string") if "layer" in nodes.columns else F.lit(None).cast("string")
    card = F.when(F.col("type").isin(*kinds), F.col("type")).when(layer.isin(*kinds), layer)
    asked = nodes.join(of.select("id").distinct(), "id", "left_semi") if of is not None else nodes
    cuts = Cuts(nodes.sparkSession)
    asked = cuts.table(asked.select(F.col("id").alias("start"), "id", card.alias("card")).where("card is not null"), "asked")
    out = []
    for facts in dict.fromkeys(kinds.values()):
        own = asked.where(F.col("card").isin(*(k for k, f in kinds.items() if f is facts)))
        out += [walk(own, edges, nodes, path, cuts).select(F.col("start").alias("id"), F.lit(fact).alias("fact"), F.col("id").alias("other")) for fact, path in facts]
    found = reduce(DataFrame.unionByName, out)
    return found.join(nodes.select(F.col("id").alias("other"), "label"), "other", "left").select("id", "fact", "other", "label")
