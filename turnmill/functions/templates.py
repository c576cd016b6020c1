"""Chat templates with supervision spans: render, mark, strip, reconcile, grow. Pure Python, called from Arrow batches.

A renderer is any object with ``apply_chat_template(messages, tokenize=False,
add_generation_prompt=..., tools=..., **options) -> str``. Where each part of a
message ends up in the rendered text is found by rendering once more with
invisible marks around the parts. Spans are dicts of start, end, source_start,
source_end, kind and role, in characters.
"""

from __future__ import annotations

import copy
import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

from .intervals import Cover, first_at, minus, union

RESERVED = frozenset({"add_generation_prompt", "tokenize", "tools"})
_ROLE_HEAD = "<|start_{0}|>assistant<|end_{0}|>".format
OPENERS = (
    _ROLE_HEAD("header_id") + "\n\n", _ROLE_HEAD("header_id"), _ROLE_HEAD("of_role"), "<|im_start|>assistant\n", "<|assistant|>\n", "<|assistant|>", "<assistant>", "<start_of_turn>model\n",
)
CLOSERS = ("</s>", "</assistant>", *(f"<|{x}|>" for x in ("eot_id", "im_end", "end_of_text")), "<end_of_turn>")
THINK_OPENERS = ("<think>\n", "<think>")
_THOUGHT = re.compile(r"(?s)<think>\n.*?</think>\n\n?|<think>.*?</think>|<\|channel>thought\n.*?<channel\|>")
_CALL = re.compile(r"(?s)<\|tool_call>.*?<tool_call\|>|<tool_call>.*?</tool_call>")
_RESPONSE = re.compile(r"(?s)<\|tool_response>.*?<tool_response\|>|<tool_response(?:\s[^>]*)?>.*?(?:</tool_response>|<tool_response\|>)")
_TURN = re.compile(r"<\|turn>(model|user|system)\n")
_MARK = re.compile(r"(?:|\\ue000)(\d+)([ab])(?:|\\ue001)")
_CONTEXT = {"tool": "tool_response", "developer": "developer", "system": "system", "user": "user"}
_STRUCTURE = frozenset({"type", "id", "role", "index"})


def is_answer(m: dict) -> bool:
    return m.get("role") in ("assistant", "model")


# rendering


class Qwen:
    """ChatML with thinking, tool calls and tool responses in tags."""

    def apply_chat_template(self, messages: list[dict], tokenize: bool = False, add_generation_prompt: bool = False, tools: list | None = None, **options: Any) -> str:
        out = []
        if tools:
            out.append("<|im_start|>system\n# Tools\n\n<tools>\n" + "\n".join(json.dumps(t, ensure_ascii=False) for t in tools) + "\n</tools><|im_end|>\n")
        for m in messages:
            body = _string(m.get("content"))
            if m["role"] == "tool":
                out.append(f"<|im_start|>user\n<tool_response>\n{body}\n</tool_response><|im_end|>\n")
                continue
            if is_answer(m):
                if m.get("reasoning_content"):
                    body = f"<think>\n{m['reasoning_content'].strip()}\n</think>\n\n{body}"
                for c in m.get("tool_calls") or []:
                    f = c["function"]
                    body += ("\n" if body else "") + f"<tool_call>\n{{\"name\": \"{f['name']}\", \"arguments\": {_arguments(f.get('arguments'))}}}\n</tool_call>"
            out.append(f"<|im_start|>{'assistant' if is_answer(m) else m['role']}\n{body}<|im_end|>\n")
        return "".join(out) + ("<|im_start|>assistant\n" if add_generation_prompt else "")


class Headers:
    """Role headers, contents trimmed; calls are JSON, and tools are not offered."""

    def apply_chat_template(self, messages: list[dict], tokenize: bool = False, add_generation_prompt: bool = False, **options: Any) -> str:
        head = "<|start_header_id|>{}<|end_header_id|>\n\n".format
        out = []
        for m in messages:
            calls = "".join(f'{{"name": "{c["function"]["name"]}", "parameters": {_arguments(c["function"].get("arguments"))}}}' for c in m.get("tool_calls") or [])
            out.append(f"{head('assistant' if is_answer(m) else 'ipython' if m['role'] == 'tool' else m['role'])}{_string(m.get('content')).strip()}{calls}<|eot_id|>")
        return "".join(out) + (head("assistant") if add_generation_prompt else "")


class Turns:
    """User and model turns; a system message precedes the first user text, and tool messages are not known."""

    def apply_chat_template(self, messages: list[dict], tokenize: bool = False, add_generation_prompt: bool = False, **options: Any) -> str:
        out, before = [], ""
        for m in messages:
            if m["role"] in ("system", "developer"):
                before += _string(m.get("content")) + "\n\n"
            elif m["role"] == "tool":
                raise ValueError("this template knows no tool messages")
            else:
                out.append(f"<start_of_turn>{'model' if is_answer(m) else 'user'}\n{'' if is_answer(m) else before}{_string(m.get('content')).strip()}<end_of_turn>\n")
                before = before if is_answer(m) else ""
        return "".join(out) + ("<start_of_turn>model\n" if add_generation_prompt else "")


class Jinja:
    """A template file's text, where the jinja2 package is installed."""

    def __init__(self, template: str):
        self.template, self._made = template, None

    def __getstate__(self) -> dict:
        return {"template": self.template, "_made": None}

    def apply_chat_template(self, messages: list[dict], tokenize: bool = False, **options: Any) -> str:
        if self._made is None:
            from jinja2.sandbox import ImmutableSandboxedEnvironment

            def fail(text: str) -> None:
                raise ValueError(text)

            env = ImmutableSandboxedEnvironment(trim_blocks=True, lstrip_blocks=True)
            env.filters["tojson"] = lambda x, **k: json.dumps(x, ensure_ascii=False)
            env.globals["raise_exception"] = fail
            self._made = env.from_string(self.template)
        return self._made.render(messages=messages, **options)


RENDERERS = {"chatml": Qwen, "headers": Headers, "turns": Turns}


def _string(content: Any) -> str:
    if isinstance(content, list):
        return "".join(p if isinstance(p, str) else str(p.get("text") or "") for p in content)
    return content or ""


def _arguments(value: Any) -> str:
    return value if isinstance(value, str) else json.dumps({} if value is None else value, ensure_ascii=False)


def checked_options(options: dict | None) -> dict:
    if taken := RESERVED & set(options or {}):
        raise ValueError(f"set by the pipeline itself: {', '.join(sorted(taken))}")
    return dict(options or {})


def text_parts(messages: list[dict], tools_as_users: bool = False) -> list[dict]:
    """Contents as lists of text parts; tool messages as user ones, where a template knows neither."""
    out = []
    for m in messages:
        m = dict(m)
        if tools_as_users and m.get("role") == "tool":
            who = m.get("name") or m.get("tool_call_id") or "tool"
            m |= {"role": "user", "content": f"<tool_response name={who!r}>{m.get('content') or ''}</tool_response>"}
        if "content" in m:
            c = m["content"]
            m["content"] = [{"type": "text", "text": c}] if isinstance(c, str) else [{"type": "text", "text": p} if isinstance(p, str) else p for p in c] if isinstance(c, list) else c
        out.append(m)
    return out


def render(renderer: Any, messages: list[dict], tools: list | None = None, options: dict | None = None, prompt: bool = False) -> str:
    """The rendered chat; what a template refuses is tried as text parts, without tools, and with tool messages as user ones."""
    base = {"tokenize": False, "add_generation_prompt": prompt, **(options or {})}
    parts = text_parts(messages)
    tries = [(messages, bool(tools)), (parts, bool(tools))]
    tries += [(messages, False), (parts, False)] if tools else []
    tries.append((text_parts(messages, True), False))
    first: Exception | None = None
    for given, with_tools in tries:
        try:
            out = renderer.apply_chat_template(given, **base, **({"tools": tools} if with_tools else {}))
        except Exception as e:  # any error of a foreign template
            first = first or e
            continue
        if not isinstance(out, str):
            raise TypeError("a renderer returns a string")
        return out
    raise first


def parsed_arguments(messages: list[dict]) -> list[dict]:
    """Arguments in JSON text as values, so that templates can walk them; text that is no JSON object or list stays."""
    out = copy.deepcopy(messages)
    for m in out:
        for c in m.get("tool_calls") or []:
            f = c["function"]
            raw = f.get("arguments")
            if raw is None or (isinstance(raw, str) and not raw.strip()):
                f["arguments"] = {}
            elif isinstance(raw, str) and raw.strip()[0] in "{[":
                try:
                    f["arguments"] = json.loads(raw)
                except ValueError:
                    pass
    return out


# marks


def _leaves(value: Any, at: tuple = ()) -> Iterator[tuple]:
    """Paths of the strings inside a value, those under structural keys last."""
    if isinstance(value, str):
        if value:
            yield at
    elif isinstance(value, list):
        for i, v in enumerate(value):
            yield from _leaves(v, (*at, i))
    elif isinstance(value, dict):
        for k in sorted(value, key=_STRUCTURE.__contains__):
            yield from _leaves(value[k], (*at, k))


def _with_marks(value: Any, n: int) -> Any:
    """The value with mark n around its strings, or None if it has none."""
    a, b = f"{n}a", f"{n}b"
    if isinstance(value, str):
        return a + value + b if value else None
    paths = [p for p in _leaves(value) if not _STRUCTURE.intersection(k for k in p if isinstance(k, str))] or list(_leaves(value))
    if not paths:
        return None
    value = copy.deepcopy(value)
    for path, change in ((paths[0], lambda s: a + s), (paths[-1], lambda s: s + b)):
        holder = value
        for k in path[:-1]:
            holder = holder[k]
        holder[path[-1]] = change(holder[path[-1]])
    return value


def mark(messages: list[dict], context: bool = True) -> tuple[list[dict], list[tuple[str, str]]]:
    """Messages with a mark around every part to be found, and the (kind, role) of each mark."""
    out, kinds = copy.deepcopy(messages), []

    def put(holder: dict, key: str, kind: str, role: str) -> None:
        made = _with_marks(holder.get(key), len(kinds))
        if made is not None:
            holder[key] = made
            kinds.append((kind, role))

    for m in out:
        role = str(m.get("role") or "")
        if is_answer(m):
            put(m, "reasoning_content", "reasoning", role)
            for c in m.get("tool_calls") or []:
                put(c["function"], "name", "tool_call", role)
                put(c["function"], "arguments", "tool_call", role)
            put(m, "content", "final_answer", role)
        elif context and role in _CONTEXT:
            put(m, "content", _CONTEXT[role], role)
    return out, kinds


def span(start: int, end: int, kind: str, role: str = "assistant") -> dict:
    return {"start": start, "end": end, "source_start": start, "source_end": end, "kind": kind, "role": role}


def strip(text: str, kinds: list[tuple[str, str]]) -> tuple[str, list[dict]]:
    """Text without marks, raw or JSON-escaped, and the spans between them; a part that a template prints twice gives two."""
    out, at, size, spans = [], 0, 0, []
    open_: dict[int, list[int]] = {}
    for m in _MARK.finditer(text):
        n = int(m[1])
        if n >= len(kinds):
            continue
        out.append(text[at : m.start()])
        size, at = size + m.start() - at, m.end()
        if m[2] == "a":
            open_.setdefault(n, []).append(size)
        elif open_.get(n):
            start = open_[n].pop()
            if start < size:
                spans.append(span(start, size, *kinds[n]))
    out.append(text[at:])
    return "".join(out), spans


def reconcile(text: str, spans: list[dict], target: str) -> list[dict] | None:
    """The spans of ``text`` in ``target``, if the two differ only in white space at or inside spans; else None.

    Templates trim contents, which marks keep from being trimmed.
    """
    starts, ends = [0] * (len(text) + 1), [0] * (len(text) + 1)
    i = j = 0
    while True:
        p, q = i, j
        while i < len(text) and text[i].isspace():
            i += 1
        while j < len(target) and target[j].isspace():
            j += 1
        if text[p:i] != target[q:j] and not any(s["start"] <= p and i <= s["end"] for s in spans):
            return None
        for k in range(p, i + 1):
            starts[k] = ends[k] = min(q + k - p, j)
        starts[p], ends[i] = q, j
        if p < i:
            starts[i] = j
        if i >= len(text) or j >= len(target):
            break
        if text[i] != target[j]:
            return None
        i, j = i + 1, j + 1
        starts[i] = ends[i] = j
    if i < len(text) or j < len(target):
        return None
    moved = [s | {"start": starts[s["start"]], "end": ends[s["end"]]} for s in spans]
    return [s | {"source_start": s["start"], "source_end": s["end"]} for s in moved if s["start"] < s["end"]]


# growing and inferring


def _found(text: str, tokens: tuple[str, ...]) -> list[tuple[int, int]]:
    """(start, end) of every occurrence of each token; the first named of two at one place."""
    at: dict[int, int] = {}
    for t in tokens:
        k = text.find(t)
        while k >= 0:
            at.setdefault(k, k + len(t))
            k = text.find(t, k + len(t))
    return sorted(at.items())


class Blocks:
    """Assistant blocks of a rendered text, found by position."""

    def __init__(self, text: str):
        self.text = text
        self.opened: list[int] = []
        self.heads: list[int] = []
        for t in sorted((k + len(o), k) for o in OPENERS for k in _places(text, o)):
            self.opened.append(t[0])
            self.heads.append(max(t[1], self.heads[-1] if self.heads else -1))
        closed = _found(text, CLOSERS)
        self.close_starts, self.close_ends = [c[0] for c in closed], [c[1] for c in closed]

    def lines_after(self, end: int) -> int:
        while end < len(self.text) and self.text[end] in "\r\n":
            end += 1
        return end

    def around(self, start: int, end: int) -> tuple[int, int] | None:
        """From the last opener before a span to the first closer after it, with the line ends that follow."""
        from bisect import bisect_right

        k, c = bisect_right(self.opened, start) - 1, first_at(self.close_starts, end)
        return None if k < 0 or c is None else (self.heads[k], self.lines_after(self.close_ends[c]))

    def closer(self, at: int) -> tuple[int, int] | None:
        c = first_at(self.close_starts, at)
        return None if c is None else (self.close_starts[c], self.close_ends[c])


def _places(text: str, token: str) -> Iterator[int]:
    k = text.find(token)
    while k >= 0:
        yield k
        k = text.find(token, k + len(token))


def _answer_block(blocks: Blocks, at: tuple[int, int], prefixes: tuple[str, ...]) -> tuple[int, int]:
    """A part grown to its assistant block behind the header; thinking that the header opens is not part of it."""
    block = blocks.around(*at)
    if block is None or not prefixes:
        return block or at
    body = blocks.text[block[0] : block[1]]
    head = next((p for p in prefixes if body.startswith(p)), None)
    if head is not None:
        return block[0] + len(head) - next((len(t) for t in THINK_OPENERS if head.endswith(t)), 0), block[1]
    head = next((p for p in OPENERS if body.startswith(p)), None)
    return (block[0] + len(head), block[1]) if head else at


def grow(text: str, spans: list[dict], prefixes: tuple[str, ...] = ()) -> list[dict]:
    """Spans grown to what delimits them: answers and thinking to their block, calls and responses to their tags."""
    blocks = Blocks(text)
    tags = {k: Cover(m.span() for m in p.finditer(text)) for k, p in (("reasoning", _THOUGHT), ("tool_call", _CALL), ("tool_response", _RESPONSE)) if any(s["kind"] == k for s in spans)}
    out = []
    for s in spans:
        old = at = (s["start"], s["end"])
        if s["kind"] in ("reasoning", "final_answer"):
            at = _answer_block(blocks, at, prefixes)
            if at == old and s["kind"] == "reasoning":
                at = tags["reasoning"].around(at)
        elif s["kind"] in tags:
            at = tags[s["kind"]].around(at)
            if s["kind"] == "tool_call" and (close := blocks.closer(at[1])) and not text[at[1] : close[0]].strip():
                block = blocks.around(*at)
                if block and close[0] < block[1]:
                    at = at[0], blocks.lines_after(close[1])
        if at[0] < at[1]:
            out.append({"source_start": old[0], "source_end": old[1]} | s | {"start": at[0], "end": at[1]})
    return out


def turn_answers(text: str) -> list[tuple[int, int]]:
    """Model turns of the template with <|turn> headers, without tool responses."""
    turns = list(_TURN.finditer(text))
    out = []
    for m, nxt in zip(turns, [*turns[1:], None]):
        if m[1] == "model":
            end = nxt.start() if nxt else len(text)
            stop = text.find("<turn|>", m.start(), end)
            out.append((m.end(), stop if stop >= 0 else end))
    return minus(out, tool_responses(text))


def thoughts(text: str) -> list[tuple[int, int]]:
    return union(m.span() for m in _THOUGHT.finditer(text))


def tool_calls(text: str) -> list[tuple[int, int]]:
    return union(m.span() for m in _CALL.finditer(text))


def tool_responses(text: str) -> list[tuple[int, int]]:
    return union(m.span() for m in _RESPONSE.finditer(text))


def infer(text: str, reasoning: bool = True) -> list[tuple[int, int]]:
    """What to train on in a text without spans: all that lies between an opener and the next closer, opener or end."""
    found = turn_answers(text)
    at = 0
    while not found or at:
        heads = [(k, -len(o)) for o in OPENERS if (k := text.find(o, at)) >= 0]
        if not heads:
            break
        k, size = min(heads)
        start = k - size
        ends = [(c, c + len(t)) for t in CLOSERS if (c := text.find(t, start)) >= 0]
        later = [c for o in OPENERS if (c := text.find(o, start)) >= 0]
        end = min(ends)[1] if ends else min(later, default=len(text))
        found.append((start, end))
        at = max(end, start + 1)
    return minus(found, tool_responses(text) + ([] if reasoning else thoughts(text)))


# one conversation


_PROBES = {
    "after_user": [{"role": "user", "content": "?"}],
    "after_tool": [
        {"role": "user", "content": "?"},
        {"role": "assistant", "content": "", "reasoning_content": "!", "tool_calls": [{"id": "c", "type": "function", "function": {"name": "f", "arguments": {"x": "y"}}}]},
        {"role": "tool", "tool_call_id": "c", "name": "f", "content": "z"},
    ],
}


def probe_contexts(messages: list[dict]) -> tuple[str, ...]:
    """Where answers stand: after a user, after a tool."""
    seen = [f"after_{b['role']}" for b, m in zip(messages, messages[1:]) if is_answer(m) and b.get("role") in ("user", "tool")]
    return tuple(dict.fromkeys(seen)) or (("after_user",) if any(map(is_answer, messages)) else ())


@dataclass
class Template:
    """A renderer with its options; the headers it puts before answers are asked once for each set of tools."""

    renderer: Any
    options: dict = field(default_factory=dict)
    strict: bool = False
    _heads: dict = field(default_factory=dict)

    def prefixes(self, messages: list[dict], tools: list) -> tuple[str, ...]:
        places = probe_contexts(messages)
        key = (json.dumps(tools, sort_keys=True, default=str), places)
        if key not in self._heads:
            if len(self._heads) >= 256:  # every row may bring its own tools
                self._heads.clear()
            got = set()
            for p in places:
                try:
                    plain, asked = (render(self.renderer, _PROBES[p], tools, self.options, ask) for ask in (False, True))
                except Exception:  # a template may refuse the probe
                    continue
                if asked.startswith(plain):
                    got.add(asked[len(plain) :])
            self._heads[key] = tuple(sorted(got - {""}, key=len, reverse=True))
        return self._heads[key]

    def _marked(self, messages: list[dict], tools: list, text: str, context: bool) -> list[dict] | None:
        marked, kinds = mark(messages, context)
        got, spans = strip(render(self.renderer, marked, tools, self.options), kinds)
        return spans if got == text else reconcile(got, spans, text)

    def spans(self, messages: list[dict], tools: list) -> tuple[str, list[dict]]:
        """The rendered text and its spans; where marks change more than white space they are inferred, or an error if ``strict``."""
        text = render(self.renderer, messages, tools, self.options)
        found = self._marked(messages, tools, text, True)
        if found is None:
            found = self._marked(messages, tools, text, False)
        if found is None and self.strict:
            raise ValueError("marks change what the template renders")
        if not found:
            return text, [span(a, b, "final_answer") for a, b in infer(text)]
        rest = minus(turn_answers(text), tool_calls(text) + tool_responses(text) + thoughts(text))
        return text, grow(text, found + [span(a, b, "final_answer") for a, b in rest], self.prefixes(messages, tools))


def trim_candidates(messages: list[dict]) -> list[list[dict]]:
    """Longest first: the starts that end right before a user turn after the first, as far as their last answer."""
    users = [i for i, m in enumerate(messages) if m.get("role") == "user"]
    ends = []
    for u in reversed(users[1:]):
        last = next((i for i in range(u - 1, -1, -1) if is_answer(messages[i])), None)
        if last is not None and last > users[0]:
            ends.append(last + 1)
    return [messages[:e] for e in dict.fromkeys(ends)]


def longest_fitting(candidates: list, size: Callable[[list], int], limit: int) -> list | None:
    """The first of ever shorter candidates within the limit, by bisection."""
    known: dict[int, int] = {}

    def fits(i: int) -> bool:
        if i not in known:
            known[i] = size(candidates[i])
        return known[i] <= limit

    low, high = 0, len(candidates)
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if fits(mid) else (mid + 1, high)
    while 0 < low < len(candidates) and fits(low - 1):  # sizes need not fall strictly
        low -= 1
    return candidates[low] if low < len(candidates) else None


def align(ids: list[int], full_ids: list[int], full_labels: list[int], ignore: int = -100) -> list[int] | None:
    """Labels of a trainer's ids from those of the text: equal, a prefix, contained, or with up to 8 special tokens at either end."""
    n, m = len(ids), len(full_ids)
    if ids == full_ids[:n]:
        return full_labels[:n]
    for k in range(n - m + 1):
        if ids[k : k + m] == full_ids:
            return [ignore] * k + full_labels + [ignore] * (n - m - k)
    sides = range(min(8, n) + 1)
    for size, k in sorted(((n - a - b, a) for a in sides for b in sides if n - a - b > 0), key=lambda x: (-x[0], x[1])):
        if size <= m and ids[k : k + size] == full_ids[:size]:
            return [ignore] * k + full_labels[:size] + [ignore] * (n - k - size)
    return None


def decoded_offsets(ids: list[int], decode: Callable[[int], str]) -> tuple[str, list[tuple[int, int]]]:
    """Text and offsets of a tokenizer that gives none, token by token."""
    parts = [decode(i) for i in ids]
    edges = [0]
    for p in parts:
        edges.append(edges[-1] + len(p))
    return "".join(parts), list(zip(edges, edges[1:]))
