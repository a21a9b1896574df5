"""Secret scans by dictionary-primed zstandard novelty (operator 10).

Known shapes of secrets (assignments, access keys, long hexadecimal runs) are
found by patterns. Beyond them, a candidate is a run of key characters, with
letters and digits, near a sensitive word. Its novelty is what it adds to the
compressed size of the text before it, with a compressor primed with
identifiers and code words: a string made of known words adds little, a random
one adds nearly its own length. Candidates above ``NOVEL_BITS`` bits a
character are reported.

Every text is scanned whole in its own row, in a map without a shuffle; the
patterns are linear in the length of the text, and a context has a fixed size.

Defined results: a null or empty text has no span; spans are in code points,
end exclusive, by start and then kind as listed; a candidate that a base span
covers or meets is not reported again; other columns are carried untouched.
"""

from __future__ import annotations

import re

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillrank.llm.common import col, map_batches, texts

KINDS = ("assign", "access", "hex", "novel")
# The base patterns and their least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
ASSIGN_LENGTH, ACCESS_LENGTH = 12, 18

SENSITIVE = ("passw", "passphrase", "secret", "token", "api", "key", "auth", "bearer", "credential", "private", "signature", "cookie", "session", "salt")
_ASSIGNED = ("password", "passwd", "secret", "token", "api")
_NEAR = re.compile("|".join(SENSITIVE))
_CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=.-])[A-Za-z0-9+/_=-]{16,}")
#: Code points between a sensitive word and a candidate behind it, and of the text that primes the compressor beside the dictionary.
REACH, CONTEXT = 48, 512
NOVEL_BITS = 5.5

#: Identifiers and words of code that a compressor knows from the start.
DICTIONARY = " ".join(
    [
        "import from include define public private protected static final const class struct function return void string boolean integer",
        "username user_name password passwd secret token access_token refresh_token api_key apikey client_id client_secret authorization bearer basic",
        "config configuration settings environment variable export default value example sample placeholder changeme your_api_key_here",
        "https://www.example.com/index.html http://localhost:8080/api/v1/ application/json charset=utf-8 content-type user-agent set-cookie session",
        "database connection host port localhost 127.0.0.1 0123456789 1234567890 abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ",
        "certificate public_key private_key signature algorithm sha256 base64 encode decode encrypt decrypt credential account service",
        "get_value set_value to_string from_string create_user update_user delete_user is_valid has_permission max_length min_length timeout retries",
        "getElementById addEventListener createElement innerHTML document window console prototype constructor arguments undefined null true false",
    ]
).encode()


class Novelty:
    """Compressed sizes with the dictionary."""

    def __init__(self) -> None:
        prime = zstandard.ZstdCompressionDict(DICTIONARY, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.compressor = zstandard.ZstdCompressor(level=3, dict_data=prime, write_checksum=False, write_content_size=False, write_dict_id=False)

    def size(self, data: str) -> int:
        return len(self.compressor.compress(data.encode("utf-8", "surrogatepass")))

    def bits(self, context: str, candidate: str) -> float:
        """Bits a character that the candidate adds to the compressed context."""
        return 8 * (self.size(context + candidate) - self.size(context)) / len(candidate)


def base_spans(text: str, low: str | None = None) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base matches that are long enough."""
    found = []
    low = text.lower() if low is None else low
    if any(w in low for w in _ASSIGNED):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LENGTH]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LENGTH]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def novel_spans(text: str, novelty: Novelty, base: list[tuple[int, int, int]], low: str | None = None, bits: float = NOVEL_BITS) -> list[tuple[int, int, int]]:
    """Candidates near a sensitive word that the dictionary and the text before them don't explain."""
    low = text.lower() if low is None else low
    if len(low) != len(text) or not any(w in low for w in SENSITIVE):
        if len(low) == len(text):
            return []
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    found, done = [], -1
    for near in _NEAR.finditer(low):
        begin = max(near.start(), done)
        for m in _CANDIDATE.finditer(text, begin, min(len(text), near.end() + REACH + 16)):
            start = m.start()
            if start > near.end() + REACH or start < done:
                continue
            whole = _CANDIDATE.match(text, start)  # to its end, however long
            if whole is None:
                continue
            end, value = whole.end(), whole.group()
            done = end
            if not (any(c.isdigit() for c in value) and any(c.isalpha() for c in value)):
                continue
            if any(a < end and start < b for a, _, b in base):
                continue
            if novelty.bits(text[max(0, start - CONTEXT) : start], value) >= bits:
                found.append((start, 3, end))
    return found


def spans_text(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in sorted(spans))


def find_secrets(docs: DataFrame, carry: list[str], text_col: str = "text", bits: float = NOVEL_BITS) -> DataFrame:
    """For each row: struct ``doc`` of the ``carry`` columns and ``spans``, an array of (kind, start, end, value)."""
    row = docs.select(F.struct(*[col(c).alias(c) for c in carry] or [F.lit(0)]).alias("doc"), col(text_col).cast("string").alias("text"))
    schema = row.select("doc", F.array().cast("array<struct<kind:string,start:bigint,end:bigint,value:string>>").alias("spans")).schema
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string())]))
    state: dict[str, Novelty] = {}

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        novelty = state.setdefault("novelty", Novelty())
        out = []
        for text in texts(batch.column(1)):
            low = text.lower()
            base = base_spans(text, low)
            spans = sorted(base + novel_spans(text, novelty, base, low, bits))
            out.append([{"kind": KINDS[k], "start": a, "end": b, "value": text[a:b]} for a, k, b in spans])
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, kind)], names=["doc", "spans"])

    return map_batches(row, schema, run)
