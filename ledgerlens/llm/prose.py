"""The English explanatory prose of source files: sentences in comments, docstrings and documentation."""

from __future__ import annotations

import re

# What begins a comment line, and what begins or ends a block.
LINE = re.compile(r"^\s*(?://+!?|#+!?|--+|;;+|%+|\*(?!/)|>|(?:[-+•]|\d+[.)])(?=\s))\s?")
CODE_MARKS = re.compile(r"[={}\[\]<>_\\|@$^~`\"]|\w\(|;\s*$|[:;]\w|\d{4,}|^\s*\w+\s*:")
TRAILING = re.compile(r"\s(?://|#|--)\s+(?=[A-Z])(.*)$")
#: A sentence runs over marks that no blank follows (2.5, e.g., names of files); the last one of a text may lack its stop.
SENTENCE = re.compile(r"(?:[^.!?]|[.!?](?!\s|$))+(?:[.!?]+|$)")
WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*|,")
# Frequent words of English and of its neighbours that are in no other list.
ENGLISH = frozenset("the a an this that these those each every it its of is are was be been and or not to for with by from when because while if so as at on into until but now than then which who whose has have does do can may must will all no only most".split())
OTHERS = frozenset(
    "el la los las un una de del que y en por para con se su es como al lo más der die das und ist ein eine einen den dem des nicht mit von zu auf für wird werden sich "
    "le les une et est dans pour sur par avec ne pas qui il di che e non per sono della nel o os da do em um uma não het een van niet voor op w z na jest nie się".split()
)
# Words of licence notices and of headers of generated files, as public licences and generators have them, and the names of licence files.
LEGAL = re.compile(r"licen[cs]e|copyright|copyleft|permission|warrant|liabilit|redistribut|all rights reserved|sublicen|merchantab|spdx", re.I)
SURE = re.compile(r"copyright\s+(?:\(c\)|©|\d{4})|spdx-license|all rights reserved", re.I)
MADE = re.compile(r"do not edit|@generated|(?:auto-?|machine[- ])generated|generated (?:by|from|file|code)", re.I)
FILE = re.compile(r"(?:^|/)(?:licen[cs]e|copying|copyright|notice|unlicense)(?:[-_.][\w.-]*)?$", re.I)
TITLE = re.compile(r"^\W*(?:[A-Z][\w-]*\s+){0,6}(?:Licen[cs]e|LICEN[CS]E)(?:,?\s+(?:v|[Vv]ersion\s+)?\d[\w., ]*)?\W*$")


def is_licence(text: str, path: str | None = None) -> bool:
    """Whether a document is a licence, by the name of its file or by its title."""
    if path and FILE.search(path):
        return True
    head = next((x for x in text.split("\n") if x.strip()), "")
    return bool(TITLE.match(head.strip("\ufeff \r")))


def is_notice(piece: str) -> bool:
    """Whether a block is the notice of a licence or the header of a generated file: one sure sign, or several legal words together."""
    return bool(SURE.search(piece) or MADE.search(piece)) or len({m.lower() for m in LEGAL.findall(piece)}) >= 2


def pieces(text: str) -> list[str]:
    """Runs of lines that are comment, docstring or documentation, each joined to one string."""
    out: list[str] = []
    run: list[str] = []
    block = ""  # how the open block ends
    skip = False  # a block that is no prose: a fence or a string literal

    def close() -> None:
        if run:
            out.append(" ".join(run))
            run.clear()

    for line in text.replace("\r\n", "\n").replace("\r", "\n").replace("﻿", "").split("\n"):
        bare = line.strip()
        if block:
            at = bare.find(block)
            inside = bare if at < 0 else bare[:at]
            if not skip:
                inside = inside.lstrip("*").strip()
                if inside and not inside.startswith("@"):
                    run.append(inside)
                else:
                    close()
            if at >= 0:
                close()
                block = ""
            continue
        if not bare:
            close()
            continue
        start = bare[:4]
        if start.startswith(("```", "~~~")):
            close()
            block, skip = bare[:3], True
            continue
        if start.startswith("/*"):
            close()
            body = bare[2:].lstrip("*!")
            at = body.find("*/")
            if at < 0:
                block, skip = "*/", False
                if body.strip():
                    run.append(body.strip())
            elif body[:at].strip():
                out.append(body[:at].strip())
            continue
        if start.startswith("<!--"):
            close()
            at = bare.find("-->")
            if at < 0:
                block, skip = "-->", False
                run.append(bare[4:].strip())
            else:
                out.append(bare[4:at].strip())
            continue
        quote = next((q for q in ('"""', "'''") if q in bare), "")
        if quote:
            at = bare.find(quote)
            docstring = bare[:at].strip().lower() in ("", "r", "u", "f", "b")
            rest = bare[at + 3 :]
            end = rest.find(quote)
            close()
            if end < 0:
                block, skip = quote, not docstring
                if docstring and rest.strip():
                    run.append(rest.strip())
            elif docstring:
                out.append(rest[:end].strip())
            continue
        mark = LINE.match(line)
        if mark:
            body = line[mark.end() :].strip()
            if not body:
                close()
            else:
                # A heading has no full stop; two comments in a row are one text.
                run.append(body)
            continue
        if len(bare) > 40 and bare.count("`") % 2 and CODE_MARKS.search(bare.replace("`", "")):
            close()
            block, skip = "`", True
            continue
        if CODE_MARKS.search(bare):
            close()
            more = TRAILING.search(bare)
            if more and '"' not in bare[: more.start()]:
                out.append(more[1])
            continue
        run.append(bare)
    close()
    return out


def english(words: list[str]) -> bool:
    """Whether a sentence is English: it has frequent English words, and more of them than of other languages."""
    mine = sum(w in ENGLISH for w in words)
    return mine > 0 and mine > sum(w in OTHERS for w in words) and sum(not w.isascii() for w in words) * 4 < len(words)


def sentences(text: str | None, path: str | None = None) -> list[list[str]]:
    """The words, lower case, of each English sentence of explanatory prose; a comma is a word of its own.

    Licence files, licence notices and headers of generated files as whole blocks, data, code and string literals give none, whole
    texts are read, and null, empty and blank ones give an empty list.
    """
    if not text or not text.strip() or is_licence(text, path):
        return []
    found = []
    for piece in pieces(text):
        if ("." not in piece and "!" not in piece and "?" not in piece) or is_notice(piece):
            continue
        for m in SENTENCE.finditer(piece):
            parts = [w.lower() for w in WORD.findall(m[0])]
            words = [w for w in parts if w != ","]
            if len(words) >= 3 and english(words):
                found.append(parts)
    return found
