"""Tool schemas: inference from samples in two dialects, merging, and validation of arguments."""

from __future__ import annotations

import json
from typing import Any


def canonical(value: Any) -> str:
    return json.dumps(value, sort_keys=True, ensure_ascii=False)


def json_type(value: Any) -> str:
    if value is None:
        return "null"
    for kind, name in ((bool, "boolean"), (int, "integer"), (float, "number"), (str, "string"), (list, "array"), (dict, "object")):
        if isinstance(value, kind):
            return name
    return "string"


def infer(value: Any) -> dict:
    """The schema of one value."""
    kind = json_type(value)
    out: dict = {"type": kind}
    if kind == "object":
        out |= {"properties": {k: infer(v) for k, v in value.items()}, "required": sorted(value)}
    elif kind == "array" and value:
        items = infer(value[0])
        for v in value[1:]:
            items = merge(items, infer(v))
        out["items"] = items
    return out


def merge(a: dict, b: dict) -> dict:
    """What both schemas allow: objects and arrays merge inside, other conflicts become anyOf."""
    if canonical(a) == canonical(b):
        return a
    if a.get("type") == b.get("type") == "object":
        pa, pb = a.get("properties", {}), b.get("properties", {})
        props = {k: merge(pa[k], pb[k]) if k in pa and k in pb else pa.get(k, pb.get(k)) for k in [*pa, *(x for x in pb if x not in pa)]}
        return {"type": "object", "properties": props, "required": sorted(set(a.get("required", [])) & set(b.get("required", [])))}
    if a.get("type") == b.get("type") == "array":
        items = [x["items"] for x in (a, b) if "items" in x]
        return {"type": "array", **({"items": items[0] if len(items) == 1 else merge(*items)} if items else {})}
    options, seen = [], set()
    for s in (a, b):
        for o in s.get("anyOf", [s]):
            if canonical(o) not in seen:
                seen.add(canonical(o))
                options.append(o)
    return {"anyOf": options}


def infer_parameters(samples: list[Any]) -> dict:
    """Parameters of a tool from samples of its arguments; required is what every sample has."""
    objects = [s for s in samples if isinstance(s, dict)]
    if not objects:
        return {"type": "object", "properties": {}}
    out = infer(objects[0])
    for s in objects[1:]:
        out = merge(out, infer(s))
    return out


def merge_types(a: dict, b: dict) -> dict:
    """The second dialect: a conflict becomes a sorted list of types."""
    if a.get("type") == b.get("type") == "object":
        pa, pb = a.get("properties", {}), b.get("properties", {})
        props = {k: merge_types(pa[k], pb[k]) if k in pa and k in pb else pa.get(k, pb.get(k)) for k in sorted({*pa, *pb})}
        return {"type": "object", "properties": props}
    if a.get("type") == b.get("type"):
        return a
    names = lambda s: s["type"] if isinstance(s.get("type"), list) else [s.get("type", "string")]
    return {"type": sorted({*names(a), *names(b)})}


def type_matches(value: Any, kind: str) -> bool:
    have = json_type(value)
    return have == kind or (kind == "number" and have == "integer") or (kind == "integer" and have == "number" and float(value).is_integer())


def validate(value: Any, schema: dict, path: str = "arguments") -> list[str]:
    """Errors of a value against type, enum, anyOf, oneOf, required, properties and additionalProperties."""
    if not isinstance(schema, dict):
        return []
    options = schema.get("anyOf") or schema.get("oneOf")
    if options and not any(not validate(value, o, path) for o in options):
        return [f"{path}: matches no option"]
    out: list[str] = []
    if kind := schema.get("type"):
        kinds = kind if isinstance(kind, list) else [kind]
        if not any(type_matches(value, k) for k in kinds):
            return [f"{path}: expected {' or '.join(map(str, kinds))}, got {json_type(value)}"]
    if "enum" in schema and value not in schema["enum"]:
        out.append(f"{path}: not one of the allowed values")
    if isinstance(value, dict):
        props, required = schema.get("properties") or {}, schema.get("required") or []
        out += [f"{path}.{k}: required" for k in required if k not in value]
        for k, v in value.items():
            if k not in props:
                if schema.get("additionalProperties") is False:
                    out.append(f"{path}.{k}: not allowed")
            elif not (v is None and k not in required):
                out += validate(v, props[k], f"{path}.{k}")
    return out
