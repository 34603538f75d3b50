"""A tool server: JSON-RPC 2.0, one message per line, over any pair of text streams."""

from __future__ import annotations

import json
from typing import IO

from quarry import __version__

TEXT, FLAG = {"type": "string"}, {"type": "boolean"}


def _whole(default: int) -> dict:
    return {"type": "integer", "minimum": 1, "default": default}


def _tool(name: str, about: str, required: list[str], **fields: dict) -> dict:
    return {"name": name, "description": about, "inputSchema": {"type": "object", "properties": fields, "required": required}}


TOOLS = [
    _tool("index_codebase", "Index a folder or file, or bring its index up to date.", ["path"], path=TEXT, force_full=FLAG, extensions={"type": "array", "items": TEXT}),
    _tool("search_code", "Search indexed code and documents.", ["query", "path"], query=TEXT, path=TEXT, top_k=_whole(8), mode={"type": "string", "enum": ["hybrid", "semantic", "keyword"], "default": "hybrid"}, filter_ext={"type": "array", "items": TEXT}, bypass_cache=FLAG),
    _tool(
        "get_context_for_prompt", "Collect the context that a prompt needs within a token budget.", ["query", "path"], query=TEXT, path=TEXT, token_budget=_whole(8000), max_files=_whole(10),
        include_related=FLAG | {"default": True}, include_docs=FLAG | {"default": True}, min_relevance={"type": "number", "minimum": 0, "maximum": 1, "default": 0.5}, scope=TEXT, bypass_cache=FLAG,
    ),
]


def handle(engine, message: dict) -> dict | None:
    """The reply to one message; notifications have none.  A tool's failure is a result, never a protocol error."""
    number, method, args = message.get("id"), message.get("method"), message.get("params") or {}
    if number is None:
        return None
    reply = {"jsonrpc": "2.0", "id": number}
    if method == "initialize":
        return reply | {"result": {"protocolVersion": args.get("protocolVersion", "2024-11-05"), "capabilities": {"tools": {}}, "serverInfo": {"name": "quarry", "version": __version__}}}
    if method == "ping":
        return reply | {"result": {}}
    if method == "tools/list":
        return reply | {"result": {"tools": TOOLS}}
    if method == "tools/call" and args.get("name") in {t["name"] for t in TOOLS}:
        try:
            out = getattr(engine, args["name"])(**(args.get("arguments") or {}))
        except Exception as e:  # noqa: BLE001  whatever fails, the caller gets an answer
            out = {"status": "error", "error": str(e)}
        return reply | {"result": {"content": [{"type": "text", "text": json.dumps(out)}], "isError": out.get("status") == "error"}}
    return reply | {"error": {"code": -32601, "message": f"unknown method or tool: {args.get('name') or method}"}}


def serve(engine, source: IO[str], sink: IO[str]) -> None:
    for line in source:
        if not line.strip():
            continue
        try:
            reply = handle(engine, json.loads(line))
        except ValueError:
            reply = {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "not JSON"}}
        if reply is not None:
            sink.write(json.dumps(reply) + "\n")
            sink.flush()
