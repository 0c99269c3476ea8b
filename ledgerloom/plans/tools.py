"""Tools: operators under a name, with a JSON schema of their arguments, called through hooks and within a deadline.

A tool is a function (spark, sf_dir, **arguments) -> DataFrame. Arguments are checked against the schema before anything
runs: no other names, no missing ones, types and ranges as said. Hooks see every call: ``pre`` may change the arguments or
refuse, ``around`` wraps the function, ``post`` may replace the result. Tools can be added while a session runs.
"""

from __future__ import annotations

import json
import threading
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators import documents, graph, identity, retrieval, vectors
from ledgerloom.sources import graph_tables
from ledgerloom.sources.tables import load

TYPES = {"string": str, "integer": int, "number": (int, float), "boolean": bool, "array": list}


class Refused(ValueError):
    """A call that the schema or a hook does not let through."""


class Overdue(TimeoutError):
    """A call that its deadline ended."""


@dataclass(frozen=True)
class Tool:
    name: str
    about: str
    schema: dict
    function: Callable[..., DataFrame]
    caller: str = "query"
    state: str = "stable"

    def checked(self, arguments: dict) -> dict:
        """Arguments with defaults; Refused for what the schema doesn't allow."""
        known = self.schema["properties"]
        if extra := sorted(set(arguments) - set(known)):
            raise Refused(f"{self.name} has no argument {extra[0]!r}")
        if lacking := [n for n in self.schema.get("required", ()) if arguments.get(n) is None]:
            raise Refused(f"{self.name} needs {lacking[0]!r}")
        out = {n: p["default"] for n, p in known.items() if "default" in p} | {n: v for n, v in arguments.items() if v is not None}
        for n, v in out.items():
            p = known[n]
            if not isinstance(v, TYPES[p["type"]]) or (isinstance(v, bool) and p["type"] != "boolean"):
                raise Refused(f"{n} is no {p['type']}")
            size = v if isinstance(v, (int, float)) and not isinstance(v, bool) else len(v) if isinstance(v, (str, list)) else None
            if size is not None and not p.get("least", size) <= size <= p.get("most", size):
                raise Refused(f"{n} is not within {p.get('least')} to {p.get('most')}")
            if "enum" in p and v not in p["enum"]:
                raise Refused(f"{n} is none of {p['enum']}")
        return out


@dataclass
class Hooks:
    """pre: (tool, arguments) -> arguments or None for no change; around: (tool, call) -> call; post: (tool, result) -> result or None."""

    pre: list[Callable] = field(default_factory=list)
    around: list[Callable] = field(default_factory=list)
    post: list[Callable] = field(default_factory=list)


class Toolbox:
    def __init__(self, tools: tuple[Tool, ...] = ()):
        self.tools: dict[str, Tool] = {}
        self.hooks = Hooks()
        for t in tools:
            self.add(t)

    def add(self, tool: Tool) -> None:
        if tool.name in self.tools:
            raise ValueError(f"{tool.name} is there already")
        self.tools[tool.name] = tool

    def call(self, spark: SparkSession, sf_dir: str, name: str, arguments: dict | None = None, rows: int | None = None, deadline: float | None = None) -> DataFrame | list:
        """The result as a DataFrame, or with ``rows`` at most so many rows of it, within ``deadline`` seconds."""
        if name not in self.tools:
            raise Refused(f"no tool {name!r}")
        tool = self.tools[name]
        arguments = tool.checked(arguments or {})
        for hook in self.hooks.pre:
            changed = hook(tool, arguments)
            arguments = arguments if changed is None else tool.checked(changed)

        def run() -> DataFrame:
            return tool.function(spark, sf_dir, **arguments)

        for hook in self.hooks.around:
            run = hook(tool, run)
        work = run if rows is None else lambda: run().limit(rows).collect()
        result = work() if deadline is None else within(spark, deadline, work)
        for hook in self.hooks.post:
            changed = hook(tool, result)
            result = result if changed is None else changed
        return result

    def catalogue(self, spark: SparkSession) -> DataFrame:
        """name, about, caller, state, schema of the tools."""
        rows = [(t.name, t.about, t.caller, t.state, json.dumps(t.schema, sort_keys=True)) for _, t in sorted(self.tools.items())]
        return spark.createDataFrame(rows, "name string, about string, caller string, state string, schema string")


def within(spark: SparkSession, seconds: float, work: Callable):
    """The result of ``work``, whose Spark jobs are cancelled when the time is over (Overdue)."""
    tag, late = f"deadline-{uuid.uuid4().hex}", threading.Event()

    def stop() -> None:
        late.set()
        spark.sparkContext.cancelJobsWithTag(tag)

    timer = threading.Timer(seconds, stop)
    spark.sparkContext.addJobTag(tag)
    timer.start()
    try:
        return work()
    except Exception as e:
        if late.is_set():
            raise Overdue(f"no result within {seconds} s") from e
        raise
    finally:
        timer.cancel()
        spark.sparkContext.removeJobTag(tag)


def _schema(required: tuple[str, ...] = (), **properties: dict) -> dict:
    return {"type": "object", "properties": properties, "required": list(required), "additionalProperties": False}


TEXT, FLAG = {"type": "string", "least": 1, "most": 400}, {"type": "boolean", "default": False}
TOPK = {"type": "integer", "least": 1, "most": 50, "default": 8}


def _seed(spark, node):
    return spark.createDataFrame([(node,)], "path string")


def _docs(spark, d):
    return load(spark, d, "documents", "doc_id", "text").where("text is not null")


def _vectors(spark, d):
    return load(spark, d, "embeddings", F.col("vec_id").alias("id"), F.col("embedding").alias("v"))


def _pages(spark, d, query, topk, include_deprecated):
    from ledgerloom.plans.retrieval_queries import _pages as pages

    return retrieval.hybrid(pages(spark, d), retrieval.Request(query, topk=min(20, topk), include_deprecated=include_deprecated))


STANDARD = (
    Tool("graph_search", "nodes by title, alias or path", _schema(("term",), term=TEXT, include_deprecated=FLAG, topk=TOPK), lambda spark, d, term, include_deprecated, topk: graph.search(graph_tables.nodes(spark, d), graph_tables.aliases(spark, d), term, include_deprecated, topk)),
    Tool("graph_relations", "edges of a node", _schema(("node",), node=TEXT, predicate={"type": "string", "default": ""}), lambda spark, d, node, predicate: graph.relations(graph_tables.edges(spark, d), _seed(spark, node), predicate)),
    Tool("graph_neighbors", "nodes around a node", _schema(("node",), node=TEXT, depth={"type": "integer", "least": 0, "most": 5, "default": 2}), lambda spark, d, node, depth: graph.neighbours(spark, graph_tables.edges(spark, d), _seed(spark, node), depth, budget=500)),
    Tool("graph_hub_of", "hubs of a node", _schema(("node",), node=TEXT), lambda spark, d, node: graph.relations(graph_tables.edges(spark, d), _seed(spark, node), "in").where("direction = 'out'")),
    Tool("path_exists", "whether two nodes are connected", _schema(("a", "b"), a=TEXT, b=TEXT), lambda spark, d, a, b: graph.connected(spark, graph_tables.edges(spark, d), spark.createDataFrame([(a, b)], "a string, b string"))),
    Tool("temporal", "facts valid at a date", _schema(("at",), at=TEXT), lambda spark, d, at: graph.as_of(graph_tables.facts(spark, d), F.lit(at).cast("timestamp"))),
    Tool("hybrid_recall", "pages for a query", _schema(("query",), query=TEXT, topk=TOPK, include_deprecated=FLAG), lambda spark, d, query, topk, include_deprecated: _pages(spark, d, query, topk, include_deprecated)[0]),
    Tool("channel_status", "what each channel gave", _schema(("query",), query=TEXT, topk=TOPK, include_deprecated=FLAG), lambda spark, d, query, topk, include_deprecated: _pages(spark, d, query, topk, include_deprecated)[1]),
    Tool("semantic_search", "vectors most like one", _schema(("vec_id",), vec_id={"type": "integer"}, topk=TOPK), lambda spark, d, vec_id, topk: vectors.top_k(_vectors(spark, d), _vectors(spark, d).where(F.col("id") == vec_id), topk)),
    Tool("source_outline", "headings of a source", _schema(("source_id",), source_id={"type": "integer"}, query={"type": "string", "default": ""}, start_line={"type": "integer", "least": 1, "default": 1}, limit={"type": "integer", "least": 1, "most": 200, "default": 40}), lambda spark, d, source_id, query, start_line, limit: documents.outline_window(documents.outline(_docs(spark, d).where(F.col("doc_id") == source_id), "doc_id", "text"), "doc_id", query, start_line, limit)),
    Tool("read_section", "a section of a page", _schema(("page", "slug"), page={"type": "integer"}, slug=TEXT), lambda spark, d, page, slug: documents.read_section(_docs(spark, d).where(F.col("doc_id") == page), "doc_id", "text", slug)),
    Tool("read_raw", "an exact slice of a source", _schema(("source", "first_line", "last_line"), source={"type": "integer"}, first_line={"type": "integer"}, last_line={"type": "integer"}), lambda spark, d, source, first_line, last_line: documents.read_raw(spark.createDataFrame([(str(source), first_line, last_line)], "source string, first_line int, last_line int"), _docs(spark, d).select(F.col("doc_id").cast("string").alias("source"), "text"))),
    Tool("node_resolve", "the node a vector belongs to", _schema(("vec_id",), vec_id={"type": "integer"}), lambda spark, d, vec_id: identity.bands(_vectors(spark, d).where(F.col("id") == vec_id), _vectors(spark, d).where(F.col("id") != vec_id))),
    Tool("recall", "what is remembered of a work", _schema(("subject",), subject=TEXT), lambda spark, d, subject: retrieval.recall(load(spark, d, "trajectory", F.col("work_id").alias("subject"), F.col("step").alias("at"), F.col("publication_date").alias("value")).where(F.col("subject") == subject)), caller="memory"),
)
