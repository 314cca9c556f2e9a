"""Results as text: JSON, TOON (tables in the manner of TOML) and CSV."""

from __future__ import annotations

import json
from typing import Any

from tessella.lang.statements import plain


class Result:
    """What a statement gives: a status, scalars that go with it, and perhaps rows (dicts; a missing field has no key)."""

    def __init__(self, status: str, rows: list[dict[str, Any]] | None = None, **scalars: Any):
        self.status, self.rows, self.scalars = status, rows, scalars

    def __repr__(self) -> str:
        return f"Result({self.status}, {self.scalars}, {self.rows})"


def render(result: Result, outcome: str = "JSON") -> str:
    return {"JSON": _json, "TOON": _toon, "CSV": _csv}[outcome](result)


def error(message: str, outcome: str = "JSON") -> str:
    return render(Result("error", message=message), outcome)


def _tagged(v: Any) -> Any:
    """A value that tells its type, as the wire format has it."""
    if v is None:
        return "None"
    if isinstance(v, bool):
        return {"Bool": v}
    if isinstance(v, int):
        return {"Int": v}
    if isinstance(v, float):
        return {"Float": v}
    if isinstance(v, str):
        return {"String": v}
    if isinstance(v, bytes | bytearray):
        return {"Bytes": list(v)}
    if isinstance(v, list):
        return {"Array": [_tagged(x) for x in v]}
    if isinstance(v, dict):
        return {"Object": {k: _tagged(x) for k, x in sorted(v.items())}}
    return {"String": str(v)}


def _dumps(x: Any) -> str:
    return json.dumps(x, ensure_ascii=False, separators=(",", ":"))


def json_row(row: dict[str, Any]) -> str:
    """A row as JSON results have it."""
    return _dumps({k: _tagged(v) for k, v in sorted(row.items())})


def json_rows(rows: list[dict[str, Any]]) -> str:
    return _json(Result("rows", rows))


def _json(r: Result) -> str:
    out: dict[str, Any] = {"status": r.status, **r.scalars}
    if r.rows is not None:
        if r.status == "rows":
            out["count"] = len(r.rows)
        out["data"] = [{k: _tagged(v) for k, v in sorted(row.items())} for row in r.rows]
    return _dumps(out)


def _toml(v: Any) -> str:
    if v is None:
        return '"none"'
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, float):
        return plain(v)
    if isinstance(v, int):
        return str(v)
    if isinstance(v, bytes | bytearray):
        return f'"<{len(v)} bytes>"'
    if isinstance(v, list):
        return "[" + ", ".join(map(_toml, v)) + "]"
    if isinstance(v, dict):
        return "{ " + ", ".join(f"{k} = {_toml(x)}" for k, x in sorted(v.items())) + " }"
    return '"' + str(v).replace("\\", "\\\\").replace('"', '\\"') + '"'


def _toon(r: Result) -> str:
    head = [("status", r.status), *r.scalars.items()]
    if r.status == "rows":
        head.append(("count", len(r.rows or [])))
    lines = [f"{k} = {_toml(v)}" for k, v in head]
    for row in r.rows or []:
        lines += ["", "[[data]]", *(f"{k} = {_toml(v)}" for k, v in sorted(row.items()))]
    return "\n".join(lines)


def _cell(v: Any) -> str:
    if v is None:
        return ""
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, float):
        return plain(v)
    if isinstance(v, bytes | bytearray):
        return f"<{len(v)} bytes>"
    if isinstance(v, list):
        return "[" + ";".join(map(_cell, v)) + "]"
    return "<object>" if isinstance(v, dict) else str(v)


def _quoted(s: str) -> str:
    return '"' + s.replace('"', '""') + '"' if any(c in s for c in ',"\n') else s


def _csv(r: Result) -> str:
    if r.rows is None:
        keys = list(r.scalars)
        return ",".join(["status", *keys]) + "\n" + ",".join([r.status, *(_quoted(_cell(r.scalars[k])) for k in keys)])
    if not r.rows:
        return "status,count\nrows,0"
    cols = list(dict.fromkeys(k for row in r.rows for k in sorted(row)))
    return "\n".join([",".join(cols), *(",".join(_quoted(_cell(row.get(c))) for c in cols) for row in r.rows)])
