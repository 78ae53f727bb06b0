"""Character references of HTML and XML, undone alike on the JVM and in Python.

A reference is ``&name;``, ``&#decimal;`` or ``&#xhex;``, its semicolon
included; anything else stays as it is.  Names are those of HTML 5.  Text is
read once, so ``&amp;lt;`` is ``&lt;``.
"""

from __future__ import annotations

import json
import re
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

NAMES = {name.removesuffix(";"): text for name, text in html5.items() if name.endswith(";")}
_REFERENCE = re.compile(r"&(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[a-zA-Z][a-zA-Z0-9]*);")
_BODY = r"^(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[a-zA-Z][a-zA-Z0-9]*);"
_BAD = "�"


def _character(code: int) -> str:
    return _BAD if code == 0 or code > 0x10FFFF or 0xD800 <= code <= 0xDFFF else chr(code)


def unescape_text(text: str) -> str:
    def one(m: re.Match) -> str:
        name = m[1]
        if name[0] != "#":
            return NAMES.get(name, m[0])
        return _character(int(name[2:], 16) if name[1] in "xX" else int(name[1:]))

    return _REFERENCE.sub(one, text) if "&" in text else text


def unescape(c: Column) -> Column:
    """``unescape_text`` as an expression; text without ``&`` is passed through."""
    names = F.from_json(F.lit(json.dumps(NAMES)), "map<string,string>")

    def piece(p: Column, i: Column) -> Column:
        name = F.regexp_extract(p, _BODY, 1)
        hexadecimal = F.lower(F.substring(name, 2, 1)) == "x"
        code = F.when(hexadecimal, F.conv(F.substring(name, 3, 6), 16, 10)).otherwise(F.substring(name, 2, 7)).cast("int")
        bad = (code == 0) | (code > 0x10FFFF) | code.between(0xD800, 0xDFFF)
        character = F.when(bad, F.lit(_BAD)).otherwise(F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))
        value = F.when(name.startswith("#"), character).when(name != "", F.try_element_at(names, name))
        rest = F.substr(p, F.length(name) + 2)
        return F.when(i == 0, p).otherwise(F.coalesce(F.concat(value, rest), F.concat(F.lit("&"), p)))

    decoded = F.array_join(F.transform(F.split(c, "&"), piece), "")
    return F.when(c.contains("&"), decoded).otherwise(c)
