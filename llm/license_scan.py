"""License scans: normalised sentences become identifiers of known license sentences, and sequences of those are matched against ordered rules.

The way of sentence-based matching (German, Manabe and Inoue, 2010): a
license is a sequence of sentences; each known sentence has an identifier,
perhaps with a version in it, and a rule names the sequence that makes up a
license. Rules are tried in order, long sequences first, and use up what they
match.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm import vectext as vt
from llm.license_sentences import BRIEF, LEAD, NAMES, NOTICE, RESERVED, RULES, SENTENCES
from llm.shared import named

#: A text without any of these, in lower case, has no known sentence.
MARKS = [b"licen", b"copyright", b"\xc2\xa9", b"permission", b"permitted", b"redistribut", b"rights reserved", b"public domain", b"free software", b"as is", b"as-is", b"warrant", b"creativecommons", b"cc0", b"gpl", b"confidential", b"the fuck", b"whatever you want"]
#: A sentence with one of these words that is not known is counted.
HINT = re.compile(r"(?i)\blicen[cs]|copyright|\u00a9|permission|redistribut|rights reserved|public domain|free software|\bas[ -]is\b|without any warranty|\b[al]?gpl")
#: A sentence without any of these is not known.
_HINT_TEXT = re.compile(
    r"(?i)\blicen[cs]|copyright|\u00a9|permission|permitted|redistribut|rights reserved|public domain|free software|\bas[ -]is\b|warrant|creativecommons|\bcc0|\b[al]?gpl|confidential|\bfuck\b|whatever you want"
    r"|\bno event\b|\bmisrepresented\b|\bplainly marked\b|this notice may|names? of|advertising materials|product includes|free to copy|terms and conditions|not evil|if not,|safest to attach|apply these terms|subject to the terms|same terms|to give the|contents of this file|copy of the mpl|this document|accompanying file|authorization"
)

_COMMENT = re.compile(r"(?m)^[ \t]*(?:[#*/;%>|]+|--+|<!--|\.\.(?= )|(?i:rem|dnl)\b)[ \t]*|[ \t]*(?:\*/|-->)[ \t]*$")
_SPLIT = re.compile(r"(?<=[.!?])(?=[\s\"')\]>]+|$)|\n\s*\n|\n(?=\s*(?:[-*\u2022o] |\(?[0-9a-z]{1,2}[.)] ))")
_MARKS = re.compile(r"^[\s#*/;%>|=~_+-]+|^\(?[0-9a-z]{1,2}[.)] +|[\"'\u201c\u201d\u2018\u2019`()\[\]{}<>]|[.,;:!?\s=~_*-]+$")
#: An address on a line of its own belongs to the sentence before, and a number to its "v."
_AT = re.compile(r"(?i)(copy of the licen[cs]e at:?|obtain one at:?|copy at:?)\s+(?=https?://)")
_VERSION = re.compile(r"(?i)\bv\.\s+(?=[0-9])")
_STOP_IN_NAME = re.compile(r"(?i)\b(inc|corp|ltd|llc|co|e\.v)\.(?=[ \t]+[a-z<(])")
_BLOCK = re.compile(r"(?mi)^[^\w\n]*(?:begin|end) licen[cs]e block[^\w\n]*$")
_BLANK = re.compile(r"\s+")


def _table() -> list[tuple[str, str, re.Pattern]]:
    """(identifier, words that must be there, pattern) of all sentences, those of names in a sentence of their own among them."""
    out = []
    for name, pattern in NAMES:
        out.append((name, re.compile(f"(?:{LEAD}|{BRIEF}){pattern}(?:,? (?:- )?(?:see|which|as) .*| a?nd .*|[,:;]? (?:included|found|available|text|copy) .*|:? https?://.*)?")))
    out += [(name, re.compile(pattern)) for name, pattern in SENTENCES]
    return out


_COMPILED = _table()
_SHORT = {"-NONCOMMERCIAL": "-NC", "-NON-COMMERCIAL": "-NC", "-SHAREALIKE": "-SA", "-SHARE-ALIKE": "-SA", "-NODERIVATIVES": "-ND", "-NODERIVS": "-ND", "-NO-DERIVATIVES": "-ND"}
_SEEN: dict[str, tuple[str, tuple[str, ...]] | None] = {}


def normalised(sentence: str) -> str:
    """Lower case, one blank between words, no comment signs, bullets, quotes, brackets and last stop; licence as license."""
    s = sentence.strip()
    for _ in range(3):
        s = _BLANK.sub(" ", _MARKS.sub("", s)).strip()
    return s.lower().replace("licence", "license")


def sentence_id(sentence: str) -> tuple[str, tuple[str, ...]] | None:
    """Identifier and captured parts of a known sentence."""
    if not _HINT_TEXT.search(sentence):
        return None
    s = normalised(sentence)
    if s not in _SEEN:
        if len(_SEEN) > 50_000:
            _SEEN.clear()
        _SEEN[s] = next(((name, tuple(g for g in m.groups() if g is not None)) for name, pattern in _COMPILED if (m := pattern.fullmatch(s))), None)
    return _SEEN[s]


def known(piece: str, cuts: str = ";:\n") -> list[tuple[str, tuple[str, ...]]]:
    """Known sentences in a piece of text: the whole, or else its parts between semicolons or colons, or else its lines, which may have no stop."""
    if (one := sentence_id(piece)) and one[0] not in (NOTICE, RESERVED):
        return [one]
    for k, cut in enumerate(cuts):
        if cut in piece and (got := [x for part in piece.split(cut) for x in known(part, cuts[k + 1 :])]) and any(x[0] != NOTICE for x in got):
            return got
    return [one] if one else []


def named_license(template: str, parts: tuple[str, ...]) -> str:
    """The license's name, with captured versions in it: whole numbers as 2.0, Creative Commons' conditions by their short names."""
    if template.startswith("CC-"):
        kind = "".join(x.upper().replace(" ", "-") for x in parts if not x[:1].isdigit())
        for long, short in _SHORT.items():
            kind = kind.replace(long, short)
        return f"CC-BY{kind}" + "".join(f"-{x}" for x in parts if x[:1].isdigit())
    if "{0}" not in template:
        return template
    if template.startswith("BSD-"):
        return template.format(*parts)
    if not parts:
        return template.replace("-{0}", "-any").removesuffix("+")
    return template.format(*(p if "." in p else f"{p}.0" for p in parts))


_SPDX_WORDS = {"apache": "Apache", "clause": "Clause", "or": "or", "later": "later", "only": "only", "unlicense": "Unlicense", "zlib": "Zlib", "artistic": "Artistic", "perl": "Perl", "beerware": "Beerware", "exception": "exception", "classpath": "Classpath"}


def spdx(expression: str) -> str:
    """An expression of license identifiers in the case that their list has them in."""
    return " ".join("-".join(_SPDX_WORDS.get(x, x.upper()) for x in word.split("-")) if word not in ("and", "or", "with") else word.upper() for word in expression.split())


def matched(ids: list[str], rules: list[tuple[str, list[str]]] = RULES) -> list[tuple[int, int, str]]:
    """(first place, place behind the last, rule's license) of all matches: rules in their order, each from left to right, on places that are free."""
    at: dict[str, list[int]] = {}
    for i, x in enumerate(ids):
        at.setdefault(x, []).append(i)
    free, out = [True] * len(ids), []
    for name, sequence in rules:
        for i in at.get(sequence[0], ()):
            stop = i + len(sequence)
            if ids[i:stop] == sequence and all(free[i:stop]):
                free[i:stop] = [False] * len(sequence)
                out.append((i, stop, name))
    return out


def scan(text: str) -> tuple[list[str], list[str], int]:
    """Licenses in order of their place, identifiers of all known sentences but notices of copyright, and sentences that hint at a license but are unknown."""
    found: list[tuple[str, tuple[str, ...]]] = []
    unknown = 0
    plain = _STOP_IN_NAME.sub(r"\1", _VERSION.sub("v", _AT.sub(r"\1 ", _COMMENT.sub("", _BLOCK.sub("\n\n", text)))))
    for piece in _SPLIT.split(plain):
        if not piece or not _HINT_TEXT.search(piece):
            continue
        if got := known(piece):
            found.extend(x for x in got if x[0] != NOTICE)
        elif HINT.search(piece):
            unknown += 1
    ids = [f[0] for f in found]
    hits = matched(ids)
    taken = {k for i, stop, _ in hits for k in range(i, stop)}
    texts, ends = {i for i, stop, _ in hits if stop - i > 1}, {stop for i, stop, _ in hits if stop - i > 1}
    names = [(i, named_license(name, next((found[k][1] for k in range(i, stop) if found[k][1]), ()))) for i, stop, name in hits if name]
    for i, x in enumerate(ids):
        if i in taken:
            continue
        if x.startswith("SPDX:"):
            names.append((i, spdx(found[i][1][0])))
        elif x in _NAMED:
            names.append((i, named_license(x, found[i][1])))
        elif x in ("CC-title", "CC-link"):
            names.append((i, named_license("CC-BY", found[i][1])))
        elif x == RESERVED and i + 1 not in texts and i not in ends:  # not beside a license's text
            names.append((i, "proprietary"))
    return list(dict.fromkeys(name for _, name in sorted(names))), [_shown(x, parts) for x, parts in found], unknown


_NAMED = {name for name, _ in NAMES}


def _shown(name: str, parts: tuple[str, ...]) -> str:
    return f"SPDX:{spdx(parts[0])}" if name.startswith("SPDX:") else named_license(name, parts) if name in _NAMED else name


def licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, licenses, sentences, n_unknown) of every row.

    licenses are the names found, each once, by first place; sentences the
    identifiers of all known sentences; n_unknown the sentences that speak of
    licenses but are not known. A null, empty or plain text has none. Whole
    texts are scanned, and repeated rows come as often as they stand.
    """
    rows = docs.select(named(id_col).alias("doc_id"), named(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in vt.pieces(batches):
            out: tuple[list, list, list] = ([], [], [])
            for t in batch.column(1):
                low = t.as_buffer().to_pybytes().lower() if t.is_valid else b""
                got = scan(t.as_py()) if any(x in low for x in MARKS) else ([], [], 0)
                for column, v in zip(out, got, strict=True):
                    column.append(v)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out[0], pa.list_(pa.string())), pa.array(out[1], pa.list_(pa.string())), pa.array(out[2], pa.int64())], ["doc_id", "licenses", "sentences", "n_unknown"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, licenses array<string>, sentences array<string>, n_unknown long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return rows.select("doc_id", F.array_join("licenses", ",").alias("licenses"), F.size("licenses").cast("long").alias("n_licenses"), F.size("sentences").cast("long").alias("n_sentences"), "n_unknown")
