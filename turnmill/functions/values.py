"""JSON values of unknown shape: text, timestamps, nested JSON, tool entries. Pure Python."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable, Iterator
from datetime import datetime, timezone
from typing import Any

from .jsonschema import infer_parameters

TEXT_BLOCKS = ("text", "input_text", "output_text")
_PROMPT_FILE = re.compile(r'(?s)\s*<file name="[^"]*-prompt\.txt">\n?(.*?)\n?</file>\s*')
_THINK = re.compile(r"(?s)<(think|thinking)>(.*?)</\1>")


def text(value: Any) -> str:
    """A string that isn't blank, stripped; else nothing."""
    return value.strip() if isinstance(value, str) else ""


def obj(value: Any) -> dict:
    return value if isinstance(value, dict) else {}


def objects(value: Any) -> list[dict]:
    return [x for x in value if isinstance(x, dict)] if isinstance(value, list) else []


def strings(value: Any) -> list[str]:
    return [x.strip() for x in value if text(x)] if isinstance(value, list) else []


def role_of(role: str) -> str:
    return {"developer": "system", "model": "assistant"}.get(role, role)


def unwrapped(prompt: str) -> str:
    m = _PROMPT_FILE.fullmatch(prompt)
    return m[1] if m else prompt


def block_text(content: Any) -> str:
    """Text blocks one a line, a wrapped prompt file unwrapped."""
    if isinstance(content, str):
        return unwrapped(content).strip()
    return unwrapped("\n".join(b["text"] for b in objects(content) if b.get("type") in TEXT_BLOCKS and isinstance(b.get("text"), str))).strip()


def joined_text(content: Any) -> str:
    """Text blocks and plain tool results, each stripped, one a line."""
    if isinstance(content, str):
        return content.strip()
    parts = [text(b.get("text")) if b.get("type") in TEXT_BLOCKS else text(b.get("content")) if b.get("type") == "tool_result" else "" for b in objects(content)]
    return unwrapped("\n".join(p for p in parts if p)).strip()


def thinking_text(content: Any) -> str | None:
    parts = [text(b.get("thinking")) or text(b.get("text")) for b in objects(content) if b.get("type") in ("thinking", "reasoning")]
    return "\n\n".join(p for p in parts if p) or None


def split_thinking(value: str) -> tuple[str, str | None]:
    """Text without inline thinking, and the thinking."""
    found = [m[2].strip() for m in _THINK.finditer(value)]
    return (_THINK.sub("", value).strip(), "\n\n".join(f for f in found if f) or None) if found else (value, None)


def content_and_thinking(content: Any) -> tuple[str, str | None]:
    return split_thinking(content if isinstance(content, str) else block_text(content))


def tagged(value: str, tag: str) -> tuple[list[str], str]:
    """Bodies of <tag> blocks, and the rest."""
    p = re.compile(rf"(?s)<{tag}>\s*(.*?)\s*</{tag}>")
    return [m[1].strip() for m in p.finditer(value)], p.sub("", value).strip()


def deep_json(value: Any) -> Any:
    """Strings that hold a JSON object or list become it, at every level."""
    if isinstance(value, dict):
        return {k: deep_json(v) for k, v in value.items()}
    if isinstance(value, list):
        return [deep_json(v) for v in value]
    if text(value)[:1] in ("{", "["):
        try:
            return deep_json(json.loads(value))
        except ValueError:
            pass
    return value


def arguments(value: Any) -> Any:
    """Call arguments as a value; text that is no JSON stays."""
    if value is None or (isinstance(value, str) and not value.strip()):
        return {}
    if isinstance(value, str):
        try:
            return deep_json(json.loads(value))
        except ValueError:
            return value
    return deep_json(value)


def decoded(value: Any, depth: int = 5) -> Any:
    """A stored value: UTF-8 bytes, a marked JSON prefix, JSON text encoded up to ``depth`` times; undecodable bytes by size."""
    if isinstance(value, (bytes, bytearray)):
        try:
            value = bytes(value).decode()
        except UnicodeDecodeError:
            return {"encoding": "binary", "size": len(value)}
    for _ in range(depth):
        if not isinstance(value, str):
            break
        raw = value.removeprefix("\0json:").strip()
        if raw[:1] not in ("{", "[", '"'):
            break
        try:
            value = json.loads(raw)
        except ValueError:
            break
    return value


def compact(value: Any) -> str:
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"))


def canonical(value: Any) -> str:
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"), sort_keys=True)


def timestamp(value: Any) -> str | None:
    """Text stripped, or an epoch in seconds or (over 1e10) milliseconds as ISO 8601."""
    if isinstance(value, bool) or not isinstance(value, (str, int, float)):
        return None
    if isinstance(value, str):
        return value.strip() or None
    try:
        at = datetime.fromtimestamp(value / 1000 if value > 1e10 else value, timezone.utc)
    except (OverflowError, OSError, ValueError):
        return None
    return at.isoformat().replace("+00:00", "Z")


def stamp_of(event: Any) -> str | None:
    """The timestamp of an event's payload, its message, or itself."""
    for part in (obj(event).get("payload"), obj(event).get("message"), event):
        for key in ("timestamp", "created_at", "createdAt"):
            if got := timestamp(obj(part).get(key)):
                return got
    return None


def first_stamp(events: Iterable[Any], is_user: Callable[[dict], bool]) -> str | None:
    return next((t for e in events if isinstance(e, dict) and is_user(e) and (t := stamp_of(e))), None)


def walk(value: Any) -> Iterator[tuple[str, Any]]:
    """(key, value) of all objects inside, a level's own strings before what lies deeper."""
    if isinstance(value, dict):
        yield from value.items()
        for v in value.values():
            yield from walk(v)
    elif isinstance(value, list):
        for v in value:
            yield from walk(v)


def find_key(value: Any, key: str, kind: type | tuple = object) -> Any:
    """The first value under a key, depth first, of a type; blank strings don't count."""
    return next((v for k, v in walk(value) if k == key and isinstance(v, kind) and (text(v) or not isinstance(v, str))), None)


def bullet_descriptions(value: str) -> dict[str, str]:
    """{tool: description} of the first bullet list under ``Available tools:``."""
    out: dict[str, str] = {}
    lines = iter(x.strip() for x in value.splitlines())
    for line in lines:
        if line == "Available tools:":
            break
    for line in lines:
        if line.startswith("- "):
            name, colon, about = (p.strip() for p in line[2:].partition(":"))
            if name and colon and about:
                out[name] = about
        elif out:
            break
    return out


# tools


def tool_name(tool: Any) -> str | None:
    return text(obj(obj(tool).get("function")).get("name")) or None


def tool_entry(value: Any) -> dict | None:
    """A function entry of any of the known spellings, or None."""
    if not isinstance(value, dict):
        return None
    f = value.get("function")
    if value.get("type") == "function" and text(obj(f).get("name")):
        return value | {"function": f | {"name": text(f["name"])}}
    if text(value.get("name")):
        body = {k: v for k, v in value.items() if k not in ("name", "type", "input_schema", "inputSchema", "schema", "parameters", "function")}
        p = parameters_of(value)
        return {"type": "function", "function": {"name": text(value["name"]), **body, **({"parameters": p} if p is not None else {})}}
    return None


def parameters_of(tool: dict) -> dict | None:
    """Parameters under any of the names they go by."""
    schema = obj(tool.get("schema"))
    tries = (tool.get("parameters"), tool.get("input_schema"), tool.get("inputSchema"), schema.get("parameters") or tool.get("schema"), obj(tool.get("function")).get("parameters"))
    return next((p for p in tries if isinstance(p, dict)), None)


def open_tool(name: str, description: str | None = None, properties: dict | None = None, required: Iterable[str] = ()) -> dict:
    """A function that takes any object."""
    p = {"type": "object", "properties": properties or {}, **({"required": list(required)} if required else {}), "additionalProperties": True}
    return {"type": "function", "function": {"name": name, **({"description": description} if description else {}), "parameters": p}}


def named_only(name: str, with_parameters: bool = True) -> dict:
    """The schema of a tool known by name alone; mcp__server__tool names its server."""
    parts = name.split("__")
    about = f"Tool {parts[-1]} of the MCP server {parts[1]}." if len(parts) == 3 and parts[0] == "mcp" else f"Tool {name}, offered by name."
    return {"description": about} | ({"parameters": {"type": "object", "properties": {}, "additionalProperties": True}} if with_parameters else {})


#: What the harnesses offer of themselves, by name. Richer catalogs can be given to the converters.
CATALOG: dict[str, dict[str, str]] = {
    "codex": {"shell": "Run a command.", "apply_patch": "Change files by a patch.", "update_plan": "Record the plan."},
    "claude_code": {
        "Bash": "Run a command.", "Read": "Read a file.", "Edit": "Replace text in a file.", "Write": "Write a file.", "Glob": "Find files by pattern.",
        "Grep": "Search in files.", "Task": "Start a helper.", "TodoWrite": "Record the plan.", "WebFetch": "Read a page.", "WebSearch": "Search the web.",
    },
    "cursor": {"read_file": "Read a file.", "edit_file": "Change a file.", "run_terminal_cmd": "Run a command.", "codebase_search": "Search by meaning.", "grep_search": "Search by pattern."},
    "droid": {"Read": "Read a file.", "Edit": "Change a file.", "Execute": "Run a command.", "Grep": "Search in files."},
    "hermes": {"terminal": "Run a command.", "read_file": "Read a file.", "write_file": "Write a file.", "web_search": "Search the web."},
    "pi": {"read": "Read a file.", "bash": "Run a command.", "edit": "Change a file.", "write": "Write a file."},
    "openclaw": {"read": "Read a file.", "exec": "Run a command.", "edit": "Change a file.", "write": "Write a file."},
}


def trace_type_name(value: Any) -> str:
    return text(value).lower().replace("-", "_")


def catalog(kind: Any) -> list[dict]:
    name = trace_type_name(kind)
    return [open_tool(n, d) for n, d in CATALOG.get("hermes" if name == "hermes_agent" else name, {}).items()]


class Tools:
    """Tools of a trace: what is explicit counts before what is known by name, and that before what calls show."""

    def __init__(self, kind: str | None = None):
        self.names: set[str] = set()
        self.known: dict[str, dict] = {}
        self.explicit: dict[str, dict] = {}
        self.samples: dict[str, list] = {}
        self.about: dict[str, str] = {}
        for t in catalog(kind):
            self.name(tool_name(t), {k: v for k, v in t["function"].items() if k != "name"})

    def name(self, name: str, schema: dict | None = None) -> None:
        """A tool by name; what is known of it already stays."""
        self.names.add(name)
        if schema:
            self.known[name] = schema | self.known.get(name, {})

    def declare(self, tools: Any) -> None:
        for t in tools if isinstance(tools, list) else []:
            entry = tool_entry(t)
            if entry:
                n = tool_name(entry)
                self.explicit[n] = entry
                self.names.add(n)
                self.known[n] = self.known.get(n, {}) | {k: v for k, v in entry["function"].items() if k != "name"}

    def called(self, name: str, given: Any) -> None:
        self.names.add(name)
        self.samples.setdefault(name, []).append(given)

    def entries(self) -> list[dict]:
        out = []
        for n in sorted(self.names):
            own = {k: v for k, v in obj(obj(self.explicit.get(n)).get("function")).items() if k != "name"}
            f = self.known.get(n, {}) | own
            if n in self.about and "description" not in own:
                f["description"] = self.about[n]
            if "parameters" not in f:
                f["parameters"] = infer_parameters(self.samples.get(n, []))
            out.append({"type": "function", "function": {"name": n, **f}})
        return out


def with_catalog(tools: Any, kind: Any) -> list[dict]:
    """A row's tools and those of its harness; without a catalog the row's own."""
    if not catalog(kind):
        return tools if isinstance(tools, list) else []
    made = Tools(kind)
    made.declare(tools)
    return made.entries()


def add_captured(tools: list[dict], captured: Any) -> list[dict]:
    """Captured tools add to a trace's own and never replace one."""
    identity = lambda t: tool_name(t) or canonical(t)
    out = {identity(t): t for t in objects(tools)}
    for t in objects(captured):
        out.setdefault(identity(t), t)
    return list(out.values())


def last_wins(tools: Iterable[dict]) -> list[dict]:
    """One entry a name, the last, by name."""
    by = {tool_name(t) or canonical(t): t for t in tools}
    return [by[k] for k in sorted(by)]


def mcp_tool(server: str, tool: dict) -> dict | None:
    """A tool listed by a server as the function server.tool."""
    name = text(tool.get("name"))
    return open_tool(f"{server}.{name}", text(tool.get("description")) or None) | {} if name and not parameters_of(tool) else (
        {"type": "function", "function": {"name": f"{server}.{name}", "description": text(tool.get("description")), "parameters": parameters_of(tool)}} if name else None
    )
