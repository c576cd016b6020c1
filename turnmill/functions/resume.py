"""What an earlier run has done: answers, completed turns, prompts to go on with. Pure Python over training rows."""

from __future__ import annotations

import re
from collections.abc import Iterable
from typing import Any

from . import values as V
from .values import obj, objects, text

FOLLOW_UP, SYSTEM = "\n\n--- follow-up ---\n\n", "\n\n--- system ---\n\n"
_LINE_ENDS = re.compile("\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]")


def said(content: Any) -> str:
    """Text of a content: strings and text of blocks, stripped, one a line."""
    if isinstance(content, str):
        return content.strip()
    parts = [text(p) or text(obj(p).get("text")) for p in content] if isinstance(content, list) else []
    return "\n".join(p for p in parts if p)


def prompt_key(prompt: str) -> str:
    return "\n".join(_LINE_ENDS.split(V.unwrapped(prompt.strip()).strip()))


def resume_key(prompts: Iterable[str]) -> str:
    """All turns; the system text does not count."""
    return FOLLOW_UP.join(map(prompt_key, prompts))


def completion_key(prompts: Iterable[str], system: str | None = None) -> str:
    return (prompt_key(system) + SYSTEM if text(system) else "") + resume_key(prompts)


def plain_user_event(event: dict) -> dict:
    """A user's event with wrapped prompt files unwrapped, wherever its content lies; other events as they are."""
    def plain(content: Any) -> Any:
        if isinstance(content, str):
            return V.unwrapped(content)
        return [V.unwrapped(b) if isinstance(b, str) else b | {"text": V.unwrapped(b["text"])} if isinstance(obj(b).get("text"), str) else b for b in content] if isinstance(content, list) else content

    if event.get("role") == "user":
        return event | {"content": plain(event.get("content"))}
    for k in ("message", "payload"):
        if obj(event.get(k)).get("role") == "user":
            return event | {k: event[k] | {"content": plain(event[k].get("content"))}}
    return event


def has_signal(m: dict) -> bool:
    """An answer with text, reasoning or calls."""
    return m.get("role") in ("assistant", "model") and bool(said(m.get("content")) or text(m.get("reasoning_content")) or m.get("tool_calls"))


def is_provider_error(m: dict) -> bool:
    return m.get("role") in ("assistant", "model") and (bool(m.get("provider_error")) or bool(re.match(r"API Error:|\w+ upstream request failed\.", said(m.get("content")))))


def has_answer(row: dict) -> bool:
    return bool(text(row.get("response"))) or any(m.get("role") == "assistant" and has_signal(m) for m in objects(row.get("messages")))


def ends_in_error(row: dict) -> bool:
    last = next((m for m in reversed(objects(row.get("messages"))) if m.get("role") in ("assistant", "model", "tool")), {})
    return is_provider_error(last)


def completed_turns(row: dict, prompts: list[str]) -> bool:
    """Every prompt stands in order as a user message and is answered; the last answer is no error and calls nothing more."""
    messages, places, at = objects(row.get("messages")), [], 0
    if not prompts or not has_answer(row):
        return False
    for want in map(prompt_key, prompts):
        at = next((i + 1 for i in range(at, len(messages)) if messages[i].get("role") == "user" and prompt_key(said(messages[i].get("content"))) == want), 0)
        if not at:
            return False
        places.append(at)
    for start, end in zip(places, [p - 1 for p in places[1:]] + [len(messages)]):
        turn = [m for m in messages[start:end] if m.get("role") in ("assistant", "model", "tool")]
        if not any(map(has_signal, turn)):
            return False
    last = turn[-1]
    return last.get("role") != "tool" and not is_provider_error(last) and not last.get("tool_calls")


def prompts_of(row: dict) -> tuple[list[str], str | None]:
    """(prompts, system) that a row was made of."""
    messages = objects(row.get("messages"))
    users = [t for m in messages if m.get("role") == "user" and (t := said(m.get("content")))]
    first = text(row.get("prompt")) or (users[0] if users else "")
    more = row.get("follow_up_prompts")
    if not isinstance(more, list):
        more = users[1:] if users and prompt_key(users[0]) == prompt_key(first) else []
    system = text(row.get("system")) or next((t for m in messages if m.get("role") == "system" and (t := said(m.get("content")))), None)
    return ([first, *more] if first else []), system


def completed_key(row: dict) -> str | None:
    """The resume key of a row that is done, else None."""
    prompts, _ = prompts_of(row)
    if not prompts:
        return None
    users = any(m.get("role") == "user" for m in objects(row.get("messages")))
    done = completed_turns(row, prompts) if users else has_answer(row) and not ends_in_error(row)
    return resume_key(prompts) if done else None


def extends(row: dict, prompts: list[str], system: str | None = None) -> int | None:
    """How many follow-ups a chat row has done of the given prompts that it can be extended to, or None."""
    own, own_system = prompts_of(row)
    if not own or not prompts or prompt_key(own[0]) != prompt_key(prompts[0]) or (own_system or None) != (text(system) or None) or not has_answer(row):
        return None
    answers = sum(has_signal(m) for m in objects(row.get("messages"))) if isinstance(row.get("messages"), list) else len(row.get("responses") or [row.get("response")])
    done = own[1 : 1 + max(0, min(len(own) - 1, answers - 1))]
    if len(done) >= len(prompts) - 1 or [prompt_key(p) for p in done] != [prompt_key(p) for p in prompts[1 : 1 + len(done)]]:
        return None
    return len(done)


def row_to_extend(rows: list[dict], prompts: list[str], system: str | None = None) -> int | None:
    """The place of the row with the most turns done, the first of several."""
    found = [(-n, i) for i, r in enumerate(rows) if (n := extends(r, prompts, system)) is not None]
    return min(found)[1] if found else None
