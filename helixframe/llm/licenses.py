"""License scans: Aho-Corasick over words, and a shunting-yard parser for licence expressions.

Text is reduced to its words (A-Z lower-cased, other ASCII but letters and
digits are gaps); one automaton holds all notice phrases, another the identifier
tag in the raw text.  The expression after a tag, up to the end of its line, is
parsed with precedence WITH > AND > OR and parentheses; its identifiers become
labels, and AND / OR / WITH evaluate how freely the text may be used.

An identifier is a family of ``FAMILIES``, with a version and a variant or without
(``gpl-2.0-or-later``, ``bsd-3-clause``), an exception (``classpath-exception-2.0``), or a reference
(``licenseref-...``).  Any other word after the tag is a fault: it gives no label.

Defined cases: null text counts as empty; a malformed expression gives the
identifiers before the fault, so ``see the file`` gives none; texts of any length are scanned whole; a repeated row
is scanned each time; a null doc_id is kept; of labels with one score any gives it;
an empty table gives none; extra columns are left out.
"""

from __future__ import annotations

import re
from functools import cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, lean, slices

#: Phrases of the contract and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Further notices: phrases as their licences word them.
NOTICES = {
    "mit license": "mit", "permission is hereby granted free of charge to any person obtaining a copy": "mit", "apache license": "apache",
    "licensed under the apache license": "apache", "mozilla public license": "mpl", "bsd license": "bsd",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd", "isc license": "isc",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "isc",
    "lesser general public license": "lgpl", "affero general public license": "agpl", "eclipse public license": "epl",
    "european union public licence": "eupl", "common development and distribution license": "cddl", "boost software license": "bsl",
    "artistic license": "artistic", "the unlicense": "unlicense", "this is free and unencumbered software released into the public domain": "unlicense",
    "do what the fuck you want to public license": "wtfpl", "zlib license": "zlib", "python software foundation license": "psf",
    "sil open font license": "ofl", "creative commons": "cc", "creative commons attribution": "cc-by", "creative commons attribution sharealike": "cc-by-sa",
    "creative commons attribution noncommercial": "cc-by-nc", "creative commons attribution noderivatives": "cc-by-nd", "cc0": "cc0", "cc by sa": "cc-by-sa",
    "cc by nc": "cc-by-nc", "cc by nd": "cc-by-nd", "public domain": "public-domain", "gnu free documentation license": "gfdl",
    "open database license": "odbl", "proprietary and confidential": "proprietary", "may not be reproduced without permission": "reserved",
}
TAG = "spdx-license-identifier:"
#: How freely a text under a label may be used, 0 to 1; unknown identifiers lie between.
FREE = {
    "mit": 1.0, "apache": 1.0, "bsd": 1.0, "isc": 1.0, "bsl": 1.0, "zlib": 1.0, "psf": 1.0, "unlicense": 1.0, "wtfpl": 1.0, "0bsd": 1.0, "cc0": 1.0,
    "public-domain": 1.0, "cc0-1.0": 1.0, "cc-by": 0.9, "artistic": 0.8, "ofl": 0.8, "mpl": 0.7, "epl": 0.7, "eupl": 0.6, "cddl": 0.7, "cc": 0.6, "lgpl": 0.6,
    "cc-by-sa": 0.5, "odbl": 0.5, "gfdl": 0.4, "gpl": 0.4, "agpl": 0.3, "cc-by-nc": 0.2, "cc-by-nd": 0.2, "cc-by-nc-sa": 0.2, "cc-by-nc-nd": 0.1,
    "proprietary": 0.0, "reserved": 0.0,
}
UNKNOWN = 0.5
#: Families of SPDX identifiers, what stands before version and variant; fixed values.
FAMILIES = (
    "0bsd aal afl agpl apache apsl artistic beerware blueoak bittorrent bsd bsl busl catosl cc cc-by cc-by-nc cc-by-nc-nd cc-by-nc-sa cc-by-nd cc-by-sa cc-pddc cc0 cddl "
    "cdla-permissive cdla-sharing cecill cern-ohl cern-ohl-p cern-ohl-s cern-ohl-w cnri-python cpal cpl curl dco dsdp ecl efl elastic epl eudatagrid eupl fsfap fsful "
    "fsfullr ftl gfdl gpl hpnd icu ijg imagemagick intel ipa ipl isc jasper json lgpl lgpllr libpng libtiff lpl lppl mirros mit mit-0 mit-cmu mit-feh mpl ms-lpl "
    "ms-pl ms-rl mulanpsl naist ncsa netcdf ngpl nist-pd nposl ntp oclc odbl odc-by ofl oldap openssl osl parity pddl php plexus polyform-noncommercial polyform-small-business "
    "postgresql psf python qpl rpl rpsl rsa-md ruby sgi-b sissl sleepycat smlnj spl sspl tcl tmate unicode-dfs unlicense upl vim w3c wtfpl x11 xfree86 xnet zend zlib zpl"
).split()
_KNOWN = re.compile(
    rf"(?:{'|'.join(map(re.escape, sorted(FAMILIES, key=len, reverse=True)))})(?:-\d+(?:\.\d+)*)?(?:-clause)?(?:-(?:only|or-later|no-invariants|invariants|universal|patent|clear|views|igo|rfn|no-rfn|cmu|feh|[a-z]{{2}}))*\+?"
    r"|[a-z0-9.+-]*exception(?:-\d+(?:\.\d+)*)?|(?:documentref-[a-z0-9.-]+:)?licenseref-[a-z0-9.-]+"
)

_GAP = bytes(c + 32 if 65 <= c <= 90 else c if c >= 0x80 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_TOKEN = re.compile(r"\(|\)|[a-z0-9][a-z0-9.+:-]*")
_RANK = {"or": 1, "and": 2, "with": 3}


@cache
def _automata():
    words, tags = ahocorasick.Automaton(), ahocorasick.Automaton()
    for phrase, label in {**BASE, **NOTICES}.items():
        words.add_word(f" {phrase} ", (len(phrase) + 2, label, phrase in BASE))
    tags.add_word(TAG, TAG)
    words.make_automaton()
    tags.make_automaton()
    return words, tags


def postfix(expression: str) -> list[str]:
    """The expression's tokens in postfix order; ends quietly at the first fault."""
    out, stack, operand = [], [], True
    for token in _TOKEN.findall(expression.lower()):
        if token == "(":
            if not operand:
                break
            stack.append(token)
        elif token == ")":
            if operand or "(" not in stack:
                break
            while stack[-1] != "(":
                out.append(stack.pop())
            stack.pop()
        elif token in _RANK:
            if operand:
                break
            while stack and stack[-1] != "(" and _RANK[stack[-1]] >= _RANK[token]:
                out.append(stack.pop())
            stack.append(token)
            operand = True
        elif not operand or not _KNOWN.fullmatch(token):
            break
        else:
            out.append(token)
            operand = False
    rest = [t for t in reversed(stack) if t != "("]
    return out + (rest[1:] if operand and rest else rest)


def leaf(identifier: str) -> float:
    family = re.split(r"[-+:]?\d", identifier)[0].rstrip("-")
    return FREE.get(identifier, FREE.get(family, UNKNOWN))


def evaluate(tokens: list[str]) -> float | None:
    """OR takes the freer side, AND the stricter; an exception frees a licence half-way."""
    stack: list[float] = []
    for t in tokens:
        if t not in _RANK:
            stack.append(leaf(t))
        elif len(stack) > 1:
            b, a = stack.pop(), stack.pop()
            stack.append(max(a, b) if t == "or" else min(a, b) if t == "and" else (1 + a) / 2)
    return stack[-1] if stack else None


def scan(text: str) -> tuple:
    """n_words, n_base, first_word, last_word, base_labels, labels, score and the parsed expressions of a text."""
    words_auto, tag_auto = _automata()
    words = text.encode().translate(_GAP).split()
    joined = " " + b" ".join(words).decode() + " "
    n, first, last, base, labels, seen, word = 0, None, None, set(), set(), 0, 0
    for end, (size, label, is_base) in words_auto.iter(joined):
        labels.add(label)
        if is_base:
            start = end - size + 1
            if start < seen:
                word, seen = 0, 0
            word, seen = word + joined.count(" ", seen, start), start
            n, base = n + 1, base | {label}
            first, last = word if first is None else min(first, word), word if last is None else max(last, word)
    free = [FREE[x] for x in labels]
    expressions = []
    low = text.translate(_LOWER)
    if TAG in low:
        for end, _ in tag_auto.iter(low):
            tokens = postfix(low[end + 1 :].split("\n", 1)[0])
            if (value := evaluate(tokens)) is not None:
                free.append(value)
                expressions.append(" ".join(tokens))
                labels |= {t for t in tokens if t not in _RANK}
    return len(words), n, first, last, ",".join(sorted(base)), ",".join(sorted(labels)), min(free) if free else 1.0, expressions


_LOWER = {c: c + 32 for c in range(65, 91)}


def license_scan(df: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score (free use, 0 to 1; 1 without a notice), expressions (postfix)."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("expressions", pa.list_(pa.string()))])

    @lean
    def scans(batches):
        for batch in batches:
            for part in slices(batch):
                rows = [(i, *scan(t or "")) for i, t in zip(part["doc_id"].to_pylist(), part["text"].to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    bounded_batches(df.sparkSession)
    docs = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(scans, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, expressions array<string>")
