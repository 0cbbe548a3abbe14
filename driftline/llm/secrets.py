"""Secrets in texts: keyword automaton, anchored expressions at its hits, checksums.

One pass of an Aho-Corasick automaton over a text finds every place where a
keyword starts (assignment words, key prefixes). Only there an expression is
tried, anchored at the hit. Runs of hexadecimal digits have no keyword; they are
probed at every 16th byte instead: a run of 32 covers two probes in a row.

Kinds, and what makes a match count:

* ``assign``, ``access``, ``hex``: the base kinds, by length (see ``BASE``);
* ``github``, ``npm``: prefix and 36 base-62 characters, the last six of which
  are the CRC-32 of the thirty before them;
* ``xprv``: a Base58Check extended private key, by its double SHA-256 checksum.

Positions are code points, the end exclusive. Per kind, matches are leftmost and
do not overlap; a match that fails its condition still uses up its text.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.llm.words import release_memory

#: The base kinds' expressions, in the order in which equal starts are listed.
BASE = {
    "assign": rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": rb"AKIA[A-Z0-9]+",
    "hex": rb"[0-9a-f]+",
}
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
GITHUB_PREFIXES = ("ghp_", "gho_", "ghu_", "ghs_", "ghr_")
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
KINDS = (*BASE, "github", "npm", "xprv")

_ASSIGN = re.compile(BASE["assign"], re.IGNORECASE)
_ACCESS = re.compile(BASE["access"])
_HEX = re.compile(BASE["hex"])
_CHECKED = re.compile(rb"(?:gh[pousr]|npm)_[0-9A-Za-z]{36}(?![0-9A-Za-z])")
_XPRV = re.compile(rb"xprv[1-9A-HJ-NP-Za-km-z]{107}(?![0-9A-Za-z])")
_IS_HEX = np.zeros(256, bool)
_IS_HEX[[*range(0x30, 0x3A), *range(0x61, 0x67)]] = True
_PROBE = 16
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for word in ASSIGN_WORDS:
        found.add_word(word, ("assign", len(word)))
    found.add_word("akia", ("access", 4))
    for word in (*GITHUB_PREFIXES, "npm_"):
        found.add_word(word, ("npm" if word == "npm_" else "github", len(word)))
    found.add_word("xprv", ("xprv", 4))
    found.make_automaton()
    return found


_KEYWORDS = _automaton()


def crc_valid(token: bytes) -> bool:
    """Prefix, 30 characters and their CRC-32 in six base-62 digits."""
    body, digits = token[4:-6], token[-6:].decode()
    value = zlib.crc32(body)
    expected = ""
    for _ in range(6):
        value, digit = divmod(value, 62)
        expected = BASE62[digit] + expected
    return digits == expected


def base58check_valid(text: bytes) -> bool:
    value = 0
    for c in text.decode():
        value = value * 58 + BASE58.index(c)
    raw = value.to_bytes(82, "big")
    return hashlib.sha256(hashlib.sha256(raw[:-4]).digest()).digest()[:4] == raw[-4:]


def _anchored(kind: str, data: bytes, at: int) -> tuple[int, bool] | None:
    """(end, whether it counts) of the kind's match that starts at ``at``."""
    if kind == "assign":
        m = _ASSIGN.match(data, at)
        return m and (m.end(), m.end(2) - m.start(2) >= 8)
    if kind == "access":
        m = _ACCESS.match(data, at)
        return m and (m.end(), m.end() - at >= 16)
    m = (_XPRV if kind == "xprv" else _CHECKED).match(data, at)
    return m and (m.end(), (base58check_valid if kind == "xprv" else crc_valid)(m.group()))


def _hex_runs(data: bytes) -> Iterator[tuple[int, int]]:
    probes = _IS_HEX[np.frombuffer(data, np.uint8)[::_PROBE]]
    done = 0
    for i in np.flatnonzero(probes[:-1] & probes[1:]):
        at = int(i) * _PROBE
        if at < done:
            continue
        # A run that started before the previous probe was found there, or is stopped in between.
        start = at
        while start > 0 and _IS_HEX[data[start - 1]]:
            start -= 1
        end = _HEX.match(data, at).end()
        done = end
        if end - start >= 32:
            yield start, end


def scan_bytes(data: bytes) -> list[tuple[str, int, int]]:
    """(kind, start, end) in bytes, by start, then kind."""
    spans, until = [], dict.fromkeys(KINDS, 0)
    hits = [
        (last + 1 - size, kind)
        for last, (kind, size) in _KEYWORDS.iter(data.translate(_LOWER).decode("latin-1"))
    ]
    for at, kind in sorted(hits):
        if at >= until[kind] and (found := _anchored(kind, data, at)):
            until[kind] = found[0]
            if found[1]:
                spans.append((kind, at, found[0]))
    spans += [("hex", a, b) for a, b in _hex_runs(data)]
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))


def scan(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start, then kind; none for a null text."""
    data = (text or "").encode()
    spans = scan_bytes(data)
    if not spans or data.isascii():
        return spans
    # A byte's code point is the number of bytes up to it that begin one.
    begins = np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)
    return [(k, int(begins[a]) - 1, int(begins[b - 1])) for k, a, b in spans]


SPANS = "array<struct<kind:string,start:int,end:int>>"


def find_secrets(docs: DataFrame, text_column: str = "text", name: str = "secrets") -> DataFrame:
    """``docs`` with a column ``name`` of the spans found in its whole texts.

    A null or empty text has none. Rows are worked on one by one, so that
    repeated rows, null ids and further columns do not matter; a column that is
    already called ``name`` is replaced.
    """
    kind = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])

    def work(texts: pa.Array) -> pa.Array:
        found = (scan(t.as_py()) for t in texts)
        return pa.array(
            [[{"kind": k, "start": a, "end": b} for k, a, b in spans] for spans in found],
            pa.list_(kind),
        )

    return docs.withColumn(name, F.arrow_udf(work, SPANS)(F.col(text_column)))


def digest_text(spans: Column, kinds: tuple[str, ...] = KINDS) -> Column:
    """``kind:start:end`` of the spans of the given kinds, joined by commas."""
    chosen = F.filter(spans, lambda s: s["kind"].isin(*kinds))
    return F.array_join(
        F.transform(chosen, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","
    )


def redact(docs: DataFrame, text_column: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span of a secret replaced by ``mark``; overlapping spans by one.

    Texts without secrets, null ones included, stay as they are.
    """

    def work(texts: pa.Array) -> pa.Array:
        out = []
        for value in texts:
            text = value.as_py()
            at, parts = 0, []
            for _, start, end in scan(text):
                if end <= at:
                    continue
                if start >= at:
                    parts += [text[at:start], mark]
                at = end
            out.append(text if not parts else "".join([*parts, text[at:]]))
        done = pa.array(out, pa.string())
        release_memory()
        return done

    return docs.withColumn(text_column, F.arrow_udf(work, "string")(F.col(text_column)))
