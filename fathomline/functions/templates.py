"""Document templates: `$name`, `${any name}` (with }} for }), `$$` for a dollar; and prompts with {{ text }}."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

MOST_BYTES, MOST_REFERENCES = 16 * 1024, 64
_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")

Part = tuple[str, str]  # ("text", literal) or ("column", name)


class TemplateError(ValueError):
    """The template is refused; the message carries the byte position."""


def parse(template: str) -> list[Part]:
    if len(template.encode()) > MOST_BYTES:
        raise TemplateError(f"template is over {MOST_BYTES} bytes")
    out: list[Part] = []

    def add(kind: str, value: str) -> None:
        if kind == "text" and out and out[-1][0] == "text":
            out[-1] = ("text", out[-1][1] + value)
        elif value or kind == "column":
            out.append((kind, value))

    at = 0
    while at < len(template):
        nxt = template.find("$", at)
        if nxt < 0:
            add("text", template[at:])
            break
        add("text", template[at:nxt])
        where = len(template[:nxt].encode())
        rest = template[nxt + 1 :]
        if rest.startswith("$"):
            add("text", "$")
            at = nxt + 2
        elif rest.startswith("{"):
            m = re.match(r"\{((?:[^}]|\}\})*)\}", rest)
            if not m:
                raise TemplateError(f"unclosed ${{ at byte {where}")
            if not m.group(1):
                raise TemplateError(f"empty reference at byte {where}")
            add("column", m.group(1).replace("}}", "}"))
            at = nxt + 1 + m.end()
        elif m := _NAME.match(rest):
            add("column", m.group())
            at = nxt + 1 + m.end()
        else:
            raise TemplateError(f"lone $ at byte {where} (write $$ for a dollar)")
    if len(set(references(out))) > MOST_REFERENCES:
        raise TemplateError(f"more than {MOST_REFERENCES} columns referenced")
    return out


def references(parts: list[Part]) -> list[str]:
    """Referenced columns, once each, in order."""
    return list(dict.fromkeys(v for k, v in parts if k == "column"))


def validate(template: str, source: str, columns: list[str], vector: str, chunked: bool = False) -> list[Part]:
    """In column mode the source must be referenced; in chunk mode $chunk must be and the source must not; the vector
    column and its successor never."""
    parts = parse(template)
    names = references(parts)
    for n in names:
        if n in (vector, f"{vector}_new"):
            raise TemplateError(f"column {n!r} holds vectors")
        if n not in columns and not (chunked and n == "chunk"):
            raise TemplateError(f"unknown column {n!r}")
    if chunked and ("chunk" not in names or source in names):
        raise TemplateError("a chunk template must reference $chunk and not the source column")
    if not chunked and source not in names:
        raise TemplateError(f"the template must reference the source column {source!r}")
    return parts


def _quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def _texts(parts: list[Part], chunk: str | None) -> list[Column]:
    return [F.lit(v) if k == "text" else F.coalesce(F.col(chunk) if chunk and v == "chunk" else _quoted(v).cast("string"), F.lit("")) for k, v in parts]


def rendered(template: str | None, source: str, chunk: str | None = None) -> Column:
    """Null where the source (or chunk) is null; null columns render as nothing; without a template the source as it is."""
    anchor = F.col(chunk) if chunk else _quoted(source)
    if template is None:
        return anchor.cast("string")
    return F.when(anchor.isNotNull(), F.concat(F.lit(""), *_texts(parse(template), chunk)))


def rendered_bytes(template: str | None, source: str, chunk: str | None = None) -> Column:
    """UTF-8 length of the rendering, without rendering."""
    anchor = F.col(chunk) if chunk else _quoted(source)
    if template is None:
        return F.octet_length(anchor.cast("string")).cast("bigint")
    sizes = [F.octet_length(t).cast("bigint") for t in _texts(parse(template), chunk)]
    return F.when(anchor.isNotNull(), reduce(lambda a, b: a + b, sizes, F.lit(0).cast("bigint")))


def prompt(template: str, text: Column | str) -> Column:
    """A model's prompt with the text put in for {{ text }}."""
    text = F.col(text) if isinstance(text, str) else text
    pieces = re.split(r"\{\{\s*text\s*\}\}", template)
    out: list[Column] = [F.lit(pieces[0])]
    for p in pieces[1:]:
        out += [text, F.lit(p)]
    return F.concat(*out)
