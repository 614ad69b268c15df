"""Clauses of texts with their offsets, a text at a time. An offset is the sum of all lengths
before it, so a text is cut where it lies and no line of it is shuffled."""

from __future__ import annotations

import re

import pyarrow as pa

from echosieve.functions import text as T

SCHEMA = "array<struct<para_index:int,pos:int,section:string,start_line:int,start:int,piece:string,next_char:string>>"
_TYPES = {"para_index": pa.int32(), "pos": pa.int32(), "section": pa.string(), "start_line": pa.int32(), "start": pa.int32(), "piece": pa.string(), "next_char": pa.string()}
_BLANKS = " \t\n\r\f\x0b"
_HEADING = re.compile(rf"#{{1,6}}{T.WS}+")
_PIECE = re.compile(f"([^{T.SEPARATORS}]+)([{T.SEPARATORS}]?)|[{T.SEPARATORS}]+")
#: Texts whose clauses are held at a time.
SLICE = 64


def paragraphs_of(text: str):
    """(section, line, offset, source) of the paragraphs: runs of lines between blank ones,
    headings and rules, without the white space around them."""
    end = text.find("\n---\n", 4) if text.startswith("---\n") else -1
    at = end + 5 if end >= 0 else 0
    section, first, begin = "(preamble)", 0, -1
    for n, raw in enumerate(text[at:].split("\n") + [""], 1):  # a last break ends the last paragraph
        line = raw.strip(_BLANKS)
        heading = _HEADING.match(line)
        if heading or line in ("---", ""):
            if begin >= 0:
                source = text[begin : at - 1]
                lead = len(source) - len(source.lstrip(_BLANKS))
                yield section, first, begin + lead, source.strip(_BLANKS)
                begin = -1
            if heading:
                section = line[heading.end() :].strip(_BLANKS)
        elif begin < 0:
            first, begin = n, at
        at += len(raw) + 1


def clauses_of(text: str):
    """The rows of SCHEMA: what stands between separators, and the separator after it."""
    for p, (section, line, start, source) in enumerate(paragraphs_of(text)):
        for k, m in enumerate(_PIECE.finditer(source)):
            if m[1]:
                yield p, k, section, line, start + m.start(), m[1], m[2] or None


def cut(batches):
    """Arrow batches that begin with the text: the rest, and the clauses of the text."""
    for batch in batches:
        for a in range(0, batch.num_rows, SLICE):
            part = batch.slice(a, SLICE)
            rows = [list(clauses_of(x.as_buffer().to_pybytes().decode("utf-8", "replace"))) for x in part.column(0)]
            offsets = [0]
            for r in rows:
                offsets.append(offsets[-1] + len(r))
            columns = zip(*(c for r in rows for c in r)) if offsets[-1] else [()] * len(_TYPES)
            fields = pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES.values())], list(_TYPES))
            yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), fields)], names=[*part.schema.names[1:], "clauses"])
