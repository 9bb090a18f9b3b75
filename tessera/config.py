"""Profiles: nested settings with inheritance, variants and fingerprints; and small reports for papers."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame


def merged(base: dict, over: dict) -> dict:
    """base with over on top; mappings are merged at all depths, other values replace."""
    out = dict(base)
    for k, v in over.items():
        out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def resolved(name: str, read: Callable[[str], dict], variant: dict | None = None) -> dict:
    """A profile with all that it extends beneath it, and a variant on top. A cycle is an error."""
    chain, seen, now = [], [], name
    while now:
        if now in seen:
            raise ValueError("profiles extend each other: " + " > ".join([*seen, now]))
        seen.append(now)
        own = dict(read(now))
        now = own.pop("extends", None)
        chain.append(own)
    out: dict = {}
    for own in reversed(chain):
        out = merged(out, own)
    return merged(out, variant or {})


def fingerprint(settings: dict) -> str:
    """16 hexadecimal digits that tell settings apart, whatever the order of their keys."""
    return hashlib.sha1(json.dumps(settings, sort_keys=True, ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()[:16]


def positive_ks(raw: str, default: tuple[int, ...] = (1, 3, 5, 10)) -> list[int]:
    """Distinct positive cut-offs in order, from text such as '5, 1,x'."""
    found = sorted({int(x) for x in raw.replace(";", ",").split(",") if x.strip().isdigit() and int(x) > 0})
    return found or list(default)


def latex(df: DataFrame, caption: str, digits: int = 3, most: int = 200) -> str:
    """A short table as LaTeX; longer ones are refused."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")

    def cell(v: object) -> str:
        text = "--" if v is None else f"{v:.{digits}f}" if isinstance(v, float) else str(v)
        return "".join("\\" + c if c in "&%$#_{}" else c for c in text)

    lines = [" & ".join(map(cell, values)) + " \\\\" for values in (df.columns, *rows)]
    table = "\n".join([lines[0] + " \\hline", *lines[1:]])
    return f"\\begin{{table}}\n\\caption{{{cell(caption)}}}\n\\begin{{tabular}}{{{'l' * len(df.columns)}}}\n{table}\n\\end{{tabular}}\n\\end{{table}}\n"
