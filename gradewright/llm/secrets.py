"""Secret scans: Aho-Corasick keyword prefilter, anchored expressions near its hits, embedded checksums.

One automaton runs over the text with A-Z lowered and gives the places of all keywords; a second finds runs of 24 hex
digits in a copy where every hex digit is one letter. Only at these places an anchored expression looks for

* ``assign``: a password, secret, token or key name, a separator, and a value of 6 characters or more,
* ``access``: an access key id of 20 characters or more,
* ``hex``: a run of 24 lower-case hex digits or more,
* ``hub``: a code-host token (``ghp_`` and its kin) whose last 6 characters are the base-62 CRC-32 of the 30 before,
* ``package``: a package-registry token (``npm_``) with the same checksum,
* ``wallet``: a private key in Base58Check behind a word such as ``wif``, valid by its double SHA-256.

The first three are the base kinds and stay whatever the checksums say; each is leftmost and non-overlapping by kind. The
last three are reported only with a valid checksum.

Defined results: a null text is empty; spans count code points, end exclusive; an empty text has no spans.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

BASE = ("assign", "access", "hex")
KINDS = (*BASE, "hub", "package", "wallet")  # in the order of a tie
HEX_LENGTH, ACCESS_LENGTH, VALUE_LENGTH = 24, 20, 6
KEYWORDS = {
    "assign": ("password", "passwd", "secret", "token", "apikey", "api_key"),
    "access": ("akia",),
    "hub": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"),
    "package": ("npm_",),
    "wallet": ("wif", "privkey", "private_key", "private key"),
}
# over the bytes of the text, each matched only where a keyword starts; the first group is the span
NEAR = {
    "assign": re.compile(rb"""((?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))"""),
    "access": re.compile(rb"(AKIA[A-Z0-9]+)"),
    "hub": re.compile(rb"(gh[pousr]_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9]))"),
    "package": re.compile(rb"(npm_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9]))"),
    "wallet": re.compile(rb"(?i:wif|privkey|private[_ ]key)[^0-9A-Za-z]{1,8}([5KL][1-9A-HJ-NP-Za-km-z]{50,51})(?![0-9A-Za-z])"),
}
HEX_RUN = re.compile(rb"[0-9a-f]+")
DIGITS62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
DIGITS58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
_AS_ONE = bytes(ord("h") if chr(c) in "0123456789abcdef" else ord(".") for c in range(256))


def checksum62(body: bytes) -> bytes:
    """The CRC-32 in base 62, six digits."""
    value, out = zlib.crc32(body), ""
    for _ in range(6):
        value, digit = divmod(value, 62)
        out = DIGITS62[digit] + out
    return out.encode()


def valid_base58check(text: bytes) -> bool:
    value = 0
    for c in text.decode():
        value = value * 58 + DIGITS58.index(c)
    data = value.to_bytes(max(38, (value.bit_length() + 7) // 8), "big").lstrip(b"\0")
    body, check = data[:-4], data[-4:]
    return len(body) in (33, 34) and body[:1] == b"\x80" and hashlib.sha256(hashlib.sha256(body).digest()).digest()[:4] == check


VALID = {
    "assign": lambda m: len(m[2]) >= VALUE_LENGTH,
    "access": lambda m: len(m[1]) >= ACCESS_LENGTH,
    "hub": lambda m: checksum62(m[2]) == m[3],
    "package": lambda m: checksum62(m[2]) == m[3],
    "wallet": lambda m: valid_base58check(m[1]),
}


def automata() -> tuple[ahocorasick.Automaton, ahocorasick.Automaton]:
    words = ahocorasick.Automaton()
    for kind, keys in KEYWORDS.items():
        for key in keys:
            words.add_word(key, (kind, len(key)))
    words.make_automaton()
    runs = ahocorasick.Automaton()
    runs.add_word("h" * HEX_LENGTH, HEX_LENGTH)
    runs.make_automaton()
    return words, runs


def scan(text: str | None, words: ahocorasick.Automaton, runs: ahocorasick.Automaton) -> list[tuple[str, int, int]]:
    """The spans (kind, start, end) of a whole text, by start, then kind as listed."""
    data = (text or "").encode("utf-8", "surrogatepass")
    spans: list[tuple[str, int, int]] = []
    done = dict.fromkeys(KINDS, 0)
    # one character per byte, so that places are byte offsets; keywords of a kind start at different places
    starts = sorted((end - length + 1, kind) for end, (kind, length) in words.iter(data.lower().decode("latin-1")))
    for start, kind in starts:
        if start >= done[kind] and (m := NEAR[kind].match(data, start)):
            done[kind] = m.end()
            if VALID[kind](m):
                spans.append((kind, *m.span(1)))
    for end, length in runs.iter(data.translate(_AS_ONE).decode("latin-1")):
        start = end - length + 1
        if start >= done["hex"]:
            m = HEX_RUN.match(data, start)
            done["hex"] = m.end()
            spans.append(("hex", *m.span()))
    if spans and len(data) != len(text):
        point = lambda at: len(data[:at].decode("utf-8", "surrogatepass"))
        spans = [(kind, point(s), point(e)) for kind, s, e in spans]
    return sorted(spans, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def listed(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


FOUND = StructType(
    [*[StructField(f"n_{k}", LongType()) for k in BASE], StructField("base_spans", StringType()), StructField("spans", StringType())]
)


def find(docs: DataFrame) -> DataFrame:
    """Adds a struct ``secrets``: counts of the base kinds, the base spans, and all spans. A column of that name is replaced."""

    @F.pandas_udf(FOUND)
    def scanned(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        words, runs = automata()
        for texts in batches:
            rows = []
            for text in texts:
                spans = scan(text, words, runs)
                base = [s for s in spans if s[0] in BASE]
                rows.append((*[sum(s[0] == k for s in base) for k in BASE], listed(base), listed(spans)))
            yield pd.DataFrame(rows, columns=FOUND.names)

    return docs.withColumn("secrets", scanned("text"))


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """The documents with every span replaced by a mark; overlapping spans share one. ``n_chars`` follows the text."""

    @F.pandas_udf(StringType())
    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        words, runs = automata()
        for texts in batches:
            out = []
            for text in texts:
                parts, at = [], 0
                for _, start, end in scan(text, words, runs):
                    if start >= at:
                        parts += [text[at:start], mark]
                    at = max(at, end)
                out.append(text if text is None else "".join([*parts, text[at:]]))
            yield pd.Series(out, dtype=object)

    out = docs.withColumn("text", cut("text"))
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def report(docs: DataFrame) -> DataFrame:
    """Per document: counts of the base kinds, the digest of the base spans, and all spans."""
    rows = find(docs.select("doc_id", "text")).select("doc_id", "secrets.*")
    return rows.select("doc_id", *[f"n_{k}" for k in BASE], F.sha2("base_spans", 256).alias("base_sha256"), "spans")
