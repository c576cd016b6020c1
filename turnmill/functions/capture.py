"""A harness's request as a context record, and display events of sessions. Pure Python."""

from __future__ import annotations

import hashlib
from typing import Any

from . import values as V
from .values import obj, objects, text

OPTIONS = ("temperature", "top_p", "max_tokens", "max_output_tokens", "reasoning", "thinking", "tool_choice", "parallel_tool_calls", "text", "stream", "store", "service_tier")
CLIP = 4000


def _text(value: Any) -> str:
    if isinstance(value, str):
        return value.strip()
    parts = [text(b) or text(obj(b).get("text")) for b in value] if isinstance(value, list) else []
    return "\n\n".join(p for p in parts if p)


def instruction_blocks(wire_api: str, request: dict) -> list[dict]:
    """What the request tells the model before the user speaks."""
    found = [("system", request.get("system"))]
    if wire_api == "openai-responses":
        found = [("developer", request.get("instructions"))] + [(i["role"], i.get("content")) for i in objects(request.get("input")) if i.get("role") in ("system", "developer")]
    return [{"role": r, "content": t} for r, c in found if (t := _text(c))]


def captured_tools(value: Any) -> list[dict]:
    """Functions in one shape; what is no function stays as declared."""
    out = []
    for t in objects(value):
        if text(t.get("name")) and not (t.get("type") == "function" and isinstance(t.get("function"), dict)):
            p = t.get("input_schema", t.get("parameters"))
            about = {"description": t["description"]} if isinstance(t.get("description"), str) else {}
            t = {"type": "function", "function": {"name": text(t["name"]), **about, "parameters": p if isinstance(p, dict) else {"type": "object", "properties": {}}}}
        out.append(t)
    return out


def captured_context(harness: str, version: str | None, wire_api: str, request: dict, captured_at: str) -> dict:
    """The same request gives the same ``context_hash``, whenever it was captured."""
    blocks = instruction_blocks(wire_api, request)
    core = {
        "source": "simulated_request_capture", "harness": harness, "harness_version": version, "wire_api": wire_api, "model": text(request.get("model")) or None, "instruction_blocks": blocks,
        "system": "\n\n".join(b["content"] for b in blocks), "tools": captured_tools(request.get("tools")), "request_options": {k: request[k] for k in OPTIONS if request.get(k) is not None},
    }
    return core | {"captured_at": captured_at, "context_hash": hashlib.sha256(V.canonical(core).encode()).hexdigest()}


def context_event(context: dict) -> dict:
    return {"type": "harness_context", "payload": context}


# display


def clip(value: str, limit: int = CLIP) -> str:
    return value if len(value) <= limit else f"{value[:limit]}\n[+{len(value) - limit} characters]"


def display(kind: str, value: Any, name: str | None = None) -> dict:
    return {"kind": kind, "text": clip(value if isinstance(value, str) else _text(value)), "name": name}


def _given(value: Any) -> str:
    return value if isinstance(value, str) else V.compact(value) if value else ""


def _block(b: dict, role: str) -> dict | None:
    kind = str(b.get("type") or "")
    if kind in ("text", "input_text", "output_text") and text(b.get("text")):
        return display("assistant" if role in ("assistant", "model") else "user", b["text"])
    if kind == "thinking" and text(b.get("thinking")):
        return display("thinking", b["thinking"])
    if kind in ("tool_use", "toolUse", "toolCall", "tool_call"):
        return display("tool_call", _given(b.get("input") or b.get("arguments")), str(b.get("name") or b.get("toolName") or "tool"))
    if kind in ("tool_result", "toolResult"):
        return display("tool_result", _text(b.get("content") or b.get("output")) or "(no output)")
    return None


def _codex_display(e: dict) -> list[dict]:
    p = obj(e.get("payload"))
    kind = p.get("type")
    if e.get("type") == "response_item":
        if kind == "message" and p.get("role") in ("assistant", "user") and _text(p.get("content")):
            return [display(p["role"], p.get("content"))]
        if kind in ("function_call", "custom_tool_call", "local_shell_call"):
            return [display("tool_call", _given(p.get("arguments") or p.get("input") or p.get("action")), str(p.get("name") or kind))]
        if kind == "function_call_output":
            out = p.get("output")
            out = out.get("content") or out.get("output") or "" if isinstance(out, dict) else out
            return [display("tool_result", _text(out) or "(no output)")]
        if kind == "reasoning" and (t := _text(p.get("summary")) or _text(p.get("content"))):
            return [display("thinking", t)]
    elif e.get("type") == "event_msg":
        shown = {"agent_message": ("assistant", p.get("message")), "agent_reasoning": ("thinking", p.get("text")), "error": ("error", p.get("message")), "task_started": ("status", "Started.")}
        if kind in shown and text(shown[kind][1]):
            return [display(*shown[kind])]
        if kind == "exec_command_begin" and p.get("command"):
            return [display("tool_call", " ".join(map(str, p["command"])) if isinstance(p["command"], list) else str(p["command"]), "shell")]
    return []


def row_display(row: dict) -> list[dict]:
    """A training row's messages."""
    out = []
    for m in objects(row.get("messages")):
        role = str(m.get("role") or "")
        if text(m.get("reasoning_content")):
            out.append(display("thinking", m["reasoning_content"]))
        out += [display("tool_call", _given(obj(c.get("function")).get("arguments")), str(obj(c.get("function")).get("name") or "tool")) for c in objects(m.get("tool_calls"))]
        if _text(m.get("content")):
            out.append(display({"tool": "tool_result", "model": "assistant"}.get(role, role), m.get("content"), m.get("name")))
    return out


def event_display(e: Any) -> list[dict]:
    """What a viewer shows of one event of any format; nothing of one that it can't read."""
    if not isinstance(e, dict):
        return []
    if isinstance(e.get("messages"), list):
        return row_display(e)
    kind, m = e.get("type"), obj(e.get("message"))
    if kind in ("response_item", "event_msg"):
        return _codex_display(e)
    if kind == "system":
        return [display("status", f"Session of {e['model']}" if e.get("model") else "Session")] if e.get("subtype") == "init" else []
    if kind == "result":
        return [display("error", str(e.get("result") or e.get("error") or "failed"))] if e.get("is_error") else []
    if kind == "external_message":
        return row_display({"messages": [e]})
    role = str(m.get("role") or e.get("role") or kind or "")
    content = m.get("content")
    if isinstance(content, str) and content.strip():
        return [display(role if role in ("user", "assistant", "system") else "tool_result", content)]
    if role in ("toolResult", "tool"):
        return [display("tool_result", content)] if _text(content) else []
    return [d for b in objects(content) if (d := _block(b, role))]


def trace_display(events: list) -> list[dict]:
    return [d for e in events for d in event_display(e)]
