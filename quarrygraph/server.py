"""The twelve questions as read-only tools over standard input and output: JSON-RPC, one message a line, in the style of the public tool protocol."""

from __future__ import annotations

import inspect
import json
import sys
import types
import typing

from pyspark.sql import DataFrame

from quarrygraph.service import Graph

TOOLS = ("search_knowledge", "get_entity", "list_entities", "recent_changes", "which_pr_introduced", "linked_context", "coverage_for", "impact_plan", "journey_coverage", "test_plan", "resolve_dependency", "knowledge_stats")
#: Version of the protocol (fixed value).
PROTOCOL = "2024-11-05"
_TYPES = {str: "string", int: "integer", float: "number", bool: "boolean"}


def _schema(method) -> dict:
    hints = typing.get_type_hints(method)
    known, needed = {}, []
    for name, p in list(inspect.signature(method).parameters.items())[1:]:
        kind = hints[name]
        if isinstance(kind, types.UnionType):
            kind = next(t for t in typing.get_args(kind) if t is not type(None))
        known[name] = {"type": _TYPES[kind]}
        needed += [name] if p.default is p.empty else []
    return {"type": "object", "properties": known, "required": needed, "additionalProperties": False}


def listed() -> list[dict]:
    tools = [(name, getattr(Graph, name)) for name in TOOLS]
    return [{"name": name, "description": inspect.getdoc(method) or name.replace("_", " "), "inputSchema": _schema(method)} for name, method in tools]


def rows(answer: DataFrame) -> list[dict]:
    """An answer is about one slug or has a limit of its own, so it fits a message."""
    return [r.asDict(True) for r in answer.collect()]


def respond(graph: Graph, message: dict) -> dict | None:
    """The answer to one message; None for a notification. An error of a tool is its result, an error of the caller a protocol error."""
    if "id" not in message:
        return None
    reply = {"jsonrpc": "2.0", "id": message["id"]}
    method, params = message.get("method"), message.get("params") or {}
    if method == "initialize":
        return {**reply, "result": {"protocolVersion": PROTOCOL, "capabilities": {"tools": {}}, "serverInfo": {"name": "quarrygraph", "version": "1"}}}
    if method == "ping":
        return {**reply, "result": {}}
    if method == "tools/list":
        return {**reply, "result": {"tools": listed()}}
    if method != "tools/call":
        return {**reply, "error": {"code": -32601, "message": f"unknown method {method!r}"}}
    name, given = params.get("name"), params.get("arguments") or {}
    if name not in TOOLS:
        return {**reply, "error": {"code": -32602, "message": f"unknown tool {name!r}"}}
    schema = _schema(getattr(Graph, name))
    odd = (set(given) - set(schema["properties"])) | (set(schema["required"]) - set(given))
    if odd:
        return {**reply, "error": {"code": -32602, "message": f"arguments missing or unknown: {', '.join(sorted(odd))}"}}
    try:
        text, failed = json.dumps(rows(getattr(graph, name)(**given)), default=str, ensure_ascii=False), False
    except Exception as error:
        text, failed = str(error)[:2000], True
    return {**reply, "result": {"content": [{"type": "text", "text": text}], "isError": failed}}


def serve(graph: Graph, lines: typing.Iterable[str] | None = None, out: typing.TextIO | None = None) -> None:
    """Answers line by line until the input ends; the repository must be known when it starts."""
    graph.check()
    out = out or sys.stdout
    for line in lines if lines is not None else sys.stdin:
        if not line.strip():
            continue
        try:
            reply = respond(graph, json.loads(line))
        except (ValueError, AttributeError):
            reply = {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "not a message"}}
        if reply is not None:
            out.write(json.dumps(reply, ensure_ascii=False) + "\n")
            out.flush()
