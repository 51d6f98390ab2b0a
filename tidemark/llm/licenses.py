"""License scans: an Aho-Corasick automaton over notice phrases and identifier
tags, and a shunting-yard parser for the licence expressions behind the tags.

Texts are lower-cased (A-Z) and read as words; a phrase is found where its
words stand consecutively. Phrases of the fixed base list are counted with
their word positions; further notices and ``SPDX-License-Identifier`` tags only
add labels and weigh in the score, unless the words before deny them (words only: ends of sentences aren't seen). An
expression goes on over lines while it is open; its operands count if they are
licences' identifiers, or look like such in an expression that has its line for
itself. Null and empty texts have no words, no
labels and score 0. Every row gives one row; other columns play no part.
"""

import re
from collections.abc import Iterator
from functools import cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Phrase, label.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Licences as texts name them: words of the name, label. Versions follow the name.
NAMES = {
    "mit": "mit", "expat": "mit", "apache": "apache", "apache 2": "apache-2.0", "apache 2 0": "apache-2.0", "bsd": "bsd", "bsd 2 clause": "bsd-2-clause", "bsd 3 clause": "bsd-3-clause", "isc": "isc", "zlib": "zlib",
    "gpl": "gpl", "gplv2": "gpl-2.0", "gpl v2": "gpl-2.0", "gpl 2 0": "gpl-2.0", "gplv3": "gpl-3.0", "gpl v3": "gpl-3.0", "gpl 3 0": "gpl-3.0", "lgpl": "lgpl", "lgplv2 1": "lgpl-2.1", "lgpl 2 1": "lgpl-2.1", "lgplv3": "lgpl-3.0", "lgpl 3 0": "lgpl-3.0",
    "agpl": "agpl", "agplv3": "agpl-3.0", "agpl 3 0": "agpl-3.0", "mpl": "mpl", "mpl 2 0": "mpl-2.0", "epl": "epl", "epl 2 0": "epl-2.0", "cddl": "cddl", "eupl": "eupl", "wtfpl": "wtfpl", "ofl": "ofl", "artistic": "artistic",
    "cc0": "cc0", "cc by nc": "cc-by-nc", "cc by sa": "cc-by-sa", "cc by nd": "cc-by-nd", "boost software": "bsl-1.0", "python software foundation": "psf", "postgresql": "postgresql", "unlicense": "unlicense",
}
#: What stands before a name where a text is put under it, and what stands behind it.
GRANTS = ("licensed under", "released under", "distributed under", "available under", "published under", "covered by", "under the terms of")
KINDS = ("license", "licence", "licensed", "licenced")
#: Further notices: phrase, label, how much one place says that the text is under a licence.
NOTICES = [
    ("cc by nc", "cc-by-nc", 0.9), ("cc by sa", "cc-by-sa", 0.9), ("cc by nd", "cc-by-nd", 0.9), ("cc0", "cc0", 0.8), ("creative commons attribution", "cc-by", 0.9),
    ("permission is hereby granted free of charge", "mit", 0.8), ("apache license version 2 0", "apache-2.0", 0.9),
    ("lesser general public license", "lgpl", 0.9), ("affero general public license", "agpl", 0.9), ("general public license version 3", "gpl-3.0", 0.9), ("general public license version 2", "gpl-2.0", 0.9),
    ("mozilla public license", "mpl", 0.9), ("mozilla public license version 2 0", "mpl-2.0", 0.9), ("eclipse public license", "epl", 0.9), ("redistribution and use in source and binary forms", "bsd", 0.8), ("european union public licence", "eupl", 0.9),
    ("common development and distribution license", "cddl", 0.9), ("sil open font license", "ofl", 0.9), ("permission to use copy modify and or distribute this software for any purpose", "isc", 0.8), ("the unlicense", "unlicense", 0.8),
    ("released into the public domain", "public-domain", 0.8), ("public domain", "public-domain", 0.4), ("without express written permission", "reserved", 0.4),
]
NOTICES += [(f"{name} {kind}", label, 0.9) for name, label in NAMES.items() for kind in KINDS]
NOTICES += [(f"{grant} {the}{name}", label, 0.9) for name, label in NAMES.items() for grant in GRANTS for the in ("", "the ", "the gnu ")]
#: Words before a notice that deny it, and those that may stand in between.
_DENIED = re.compile(r" (?:not|never|nor|without|no longer|(?:is|are|was|were)n t)(?: (?:being|licensed|released|distributed|available|published|covered|provided|offered|under|by|the|a|an|any|terms|of|gnu))* $")
BASE_WEIGHT = {"cc-by": 0.7, "gpl": 0.9, "reserved": 0.5}
TAG = "spdx license identifier"
_TAG = re.compile(r"spdx-license-identifier\s*:", re.IGNORECASE | re.ASCII)
_TOKEN = re.compile(r"[ \t]*([()]|[A-Za-z0-9][A-Za-z0-9.+:-]*)")
#: The end of a line within an expression, with the comment marks that begin the next.
_NEXT_LINE = re.compile(r"[ \t]*(?:\*/)?[ \t]*\r?\n[ \t]*(?:(?://+|#+|/?\*+|--+|;+|%+|<!--)[ \t]*)?")
#: What may stand behind an expression in its line.
_CLOSED = re.compile(r"[\s*/#\"'`>\])}.,;-]*(?:\n|\r|$)")
#: Beginnings of licences' and exceptions' identifiers, in lower case; a version or variant may follow.
KNOWN = re.compile(
    r"(?:0bsd|aal|afl|agpl|apache|apsl|artistic|beerware|blessing|boost|bsd|bsl|busl|bzip2|cc-by|cc0|cddl|cecill|classpath-exception|cpl|curl|ecl|epl|eupl|expat|ftl|gcc-exception|gfdl|gpl|hpnd|icu|ijg|intel|ipl|isc|json|lgpl|libpng|licenseref|documentref|linux-syscall-note"
    r"|llvm-exception|lppl|mit|mpl|ms-pl|ms-rl|mulanpsl|ncsa|nist|odbl|ofl|openssl|osl|pddl|php|postgresql|psf|python|qpl|ruby|sgi|sissl|sleepycat|spl|sspl|tcl|unicode|unlicense|upl|vim|w3c|wtfpl|x11|zlib|zpl)(?:[-+.:0-9]\S*)?"
)
#: Other operands that look like identifiers: with a digit or hyphen, or in capitals.
_COINED = re.compile(r"(?!(?:NONE|NOASSERTION|TODO|TBD|FIXME|UNKNOWN|N)$)(?:[A-Z]{2,}|\S*[0-9-]\S*)")
#: Words of an expression that are operators, and how tightly they bind.
PRECEDENCE = {"or": 1, "and": 2, "with": 3}

#: Bytes that are no words' become spaces, A-Z become a-z.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


@cache
def automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for phrase in {*BASE, *(n[0] for n in NOTICES), TAG}:
        a.add_word(f" {phrase} ", phrase)
    a.make_automaton()
    return a


_NOTICE = {n[0]: n[1:] for n in NOTICES}


def parsed(text: str, at: int = 0, end: int | None = None) -> tuple[list[str], int, bool]:
    """The tokens in postfix order (shunting-yard) of the expression that begins at ``at``, where it ends, and whether it is complete and nothing else stands in its line. It goes on in the next line while a parenthesis is open or an operand is due; it stops before the first token that can't follow."""
    end = len(text) if end is None else end
    out: list[str] = []
    ops: list[str] = []
    operand = True
    open_ = 0
    while True:
        m = _TOKEN.match(text, at, end)
        if m is None:
            if (out or ops) and (open_ or operand) and (line := _NEXT_LINE.match(text, at, end)) and (m := _TOKEN.match(text, line.end(), end)):
                pass
            else:
                break
        token = m[1]
        op = token.lower()
        if operand and op == "(":
            ops.append("(")
            open_ += 1
        elif operand and op not in PRECEDENCE and op != ")":
            out.append(token)
            operand = False
        elif not operand and op == ")" and open_:
            while ops[-1] != "(":
                out.append(ops.pop())
            ops.pop()
            open_ -= 1
        elif not operand and op in PRECEDENCE:
            while ops and ops[-1] != "(" and PRECEDENCE[ops[-1]] >= PRECEDENCE[op]:
                out.append(ops.pop())
            ops.append(op)
            operand = True
        else:
            break
        at = m.end()
    out += [o for o in reversed(ops) if o != "("]
    return out, at, not operand and not open_ and _CLOSED.match(text, at, end) is not None


def postfix(expression: str) -> list[str]:
    """The expression's tokens in postfix order. Unbalanced parentheses are closed at the end."""
    return parsed(expression)[0]


def credible(tokens: list[str], complete: bool) -> bool:
    """Whether all operands are identifiers: known ones, or, in a complete expression, such as look like one."""
    return all(t in PRECEDENCE or KNOWN.fullmatch(t.lower()) or (complete and _COINED.fullmatch(t)) for t in tokens)


def licences(tokens: list[str]) -> tuple[set[str], bool]:
    """All licences of an expression's alternatives, without forming these, and whether it was well formed."""
    stack: list[set[str]] = []
    whole = True
    for t in tokens:
        if t in PRECEDENCE:
            if len(stack) < 2:
                whole = False
                continue
            b, a = stack.pop(), stack.pop()
            if t == "with":
                stack.append({f"{x}-with-{y}" for x in a for y in b})
            else:
                small, large = sorted((a, b), key=len)
                large |= small
                stack.append(large)
        else:
            stack.append({t.lower()})
    return set().union(*stack), whole and len(stack) == 1


def scan_text(text: str | None) -> dict:
    """Words, base places, labels and score of one text."""
    parts = (text or "").encode("utf-8", "replace").translate(_FOLD).split()
    out = {"n_words": len(parts), "n_base": 0, "first_word": None, "last_word": None, "base_labels": "", "labels": "", "expressions": [], "score": 0.0}
    if not parts:
        return out
    flat = f" {b' '.join(parts).decode('latin-1')} "
    hits = sorted((end - len(phrase) - 1, phrase) for end, phrase in automaton().iter(flat))
    if not hits:
        return out
    places, base, labels, doubt = [], set(), set(), 1.0
    seen, word, tagged = 0, 0, False
    for start, phrase in hits:
        word += flat.count(" ", seen, start)
        seen = start
        if phrase in BASE:
            places.append(word)
            base.add(BASE[phrase])
            doubt *= 1 - BASE_WEIGHT[BASE[phrase]]
        if phrase in _NOTICE and not _DENIED.search(flat, max(0, start - 99), start + 1):
            label, weight = _NOTICE[phrase]
            labels.add(label)
            doubt *= 1 - weight
        tagged |= phrase == TAG
    if tagged:
        tags = [m.span() for m in _TAG.finditer(text or "")]
        for (_, at), (until, _) in zip(tags, [*tags[1:], (len(text), 0)], strict=True):
            tokens, to, complete = parsed(text, at, until)
            named, whole = licences(tokens)
            if named and credible(tokens, complete):
                labels |= named
                out["expressions"].append(" ".join(text[at:to].split()))
                doubt *= 1 - (0.95 if whole and complete else 0.8)
    if places:
        out |= {"n_base": len(places), "first_word": min(places), "last_word": max(places)}
    return out | {"base_labels": ",".join(sorted(base)), "labels": ",".join(sorted(base | labels)), "score": 1 - doubt}


_OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("expressions", pa.list_(pa.string()))])


def scan(docs: DataFrame) -> DataFrame:
    """One row per document: words, base places and labels, all labels, the tags' expressions, and a score from 0 to 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [scan_text(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), *(pa.array([r[f.name] for r in rows], f.type) for f in list(_OUT)[1:])], schema=_OUT)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, expressions array<string>")
